"""Part of lodestone; see the README for the layout."""
