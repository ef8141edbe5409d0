"""Feature registry: name -> function of a sheet, grouped in blocks."""

from __future__ import annotations


class FeatureSet(dict):
    """name -> builder; ``blocks`` maps a block id to its feature names in order."""

    def __init__(self, *parents):
        super().__init__()
        self.blocks = {}
        for parent in parents:
            self.update(parent)

    def block(self, block_id, **builders):
        self.update(builders)
        self.blocks.setdefault(block_id, []).extend(builders)

    def same(self, **aliases):
        """Features that are defined as another feature of the set."""
        return {name: (lambda p, source=source: p.f(source)) for name, source in aliases.items()}
