"""Plain versions that several tests compare with."""


def plain_groups(texts):
    """The lists of places whose texts are linked, directly or by others, at a Jaccard similarity of 0.8 of five-word shingles."""

    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, root = [cut(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return [[i for i, r in enumerate(root) if r == g] for g in sorted(set(root))]
