"""Which input files belong together."""

from __future__ import annotations

import os
from collections import defaultdict


def genome_groups(paths: list[str], k: int | None = None) -> dict[str, dict[str, str]]:
    """Files by the prefix of their names: one FASTA file (haploid), or two, paternal and maternal, and a .map (diploid).

    Raises ValueError for any other group, and for a k that isn't a multiple of 4 (a packed word's bases).
    """
    if k is not None and (k <= 0 or k % 4):
        raise ValueError(f"k must be a multiple of 4, not {k}")
    groups: dict[str, list[str]] = defaultdict(list)
    for p in paths:
        groups[os.path.basename(p).split("_")[0].split(".")[0]].append(p)
    out = {}
    for prefix, files in groups.items():
        maps = [f for f in files if f.endswith(".map")]
        fasta = sorted(f for f in files if f.endswith((".fa", ".fasta")))
        if len(fasta) == 1 == len(files):
            out[prefix] = {"reference": fasta[0]}
            continue
        by = {kind: f for f in fasta for kind in ("paternal", "maternal") if kind in os.path.basename(f).lower()}
        if len(files) != 3 or len(maps) != 1 or set(by) != {"paternal", "maternal"}:
            raise ValueError(f"{prefix}: one FASTA file, or a paternal and a maternal one and a .map file, not {files}")
        out[prefix] = {**by, "map": maps[0]}
    return out
