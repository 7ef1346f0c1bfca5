"""What the findings of round 3 found wrong in the training-data operators."""


def test_personal_data_holds_a_bounded_share_of_a_batch(monkeypatch):
    from lodestone.llm import pii

    texts = [" ".join(str((i * 7 + j) % 100) for j in range(200)) for i in range(40)] + [None, "mail a.b@c.de or +49 170 1234567"]
    model = pii.fit(texts[:3] + texts[-1:])
    monkeypatch.setattr(pii, "CHARS", 1 << 30)
    want = pii.find_all(texts, model)
    seen, plain = [], pii.SkipChainCRF.marginals
    monkeypatch.setattr(pii.SkipChainCRF, "marginals", lambda self, f, c, s: seen.append(len(f)) or plain(self, f, c, s))
    monkeypatch.setattr(pii, "CHARS", 1000)
    assert pii.find_all(texts, model) == want
    assert len(seen) > 10 and max(seen) < 500
