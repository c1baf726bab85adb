"""A run's settings, written and read as JSON."""

from __future__ import annotations

import dataclasses
import json

from helixplane.functions.quality import ENCODINGS
from helixplane.operators.spliced import LEAST_INTRON


@dataclasses.dataclass
class Config:
    genome: list[str]
    output: str
    unpaired: str | None = None
    pair1: str | None = None
    pair2: str | None = None
    k: int = 20
    control: str | None = None  # a chip's negative control, unpaired or the files of its pairs
    control1: str | None = None
    control2: str | None = None
    assay: str | None = None  # cage, chip or rna
    fragment_lengths: str | None = None
    model: str = "estimated"  # or mismatch
    floor_p: float = 0.1
    samples: int = 0
    soft_clip: int = 0
    threshold: float = 0.0
    encoding: str | None = None  # of qualities, as given or as a run finds it
    intron: int = 500_000  # the longest one
    threads: int = 0  # shuffle partitions of a run, 0 for the session's

    def __post_init__(self) -> None:
        if (self.unpaired is None) == (self.pair1 is None) or (self.pair1 is None) != (self.pair2 is None):
            raise ValueError("give either unpaired reads or both files of pairs")
        if self.assay not in (None, "cage", "chip", "rna"):
            raise ValueError("assays are cage, chip and rna")
        if self.assay == "chip" and self.unpaired and not self.fragment_lengths:
            raise ValueError("chip of single reads needs fragment lengths")
        if (self.control or self.control1 or self.control2) and self.assay != "chip":
            raise ValueError("controls belong to chip")
        if (self.control1 is None) != (self.control2 is None) or (self.control and not self.unpaired) or (self.control1 and self.unpaired):
            raise ValueError("a control's reads are unpaired or in pairs as the treatment's")
        if self.encoding is not None and self.encoding not in ENCODINGS:
            raise ValueError(f"encodings are {', '.join(ENCODINGS)}")
        if self.model not in ("mismatch", "estimated"):
            raise ValueError("models are mismatch and estimated")
        if self.samples and self.assay not in ("cage", "chip"):
            raise ValueError("samples need cage or chip")
        if self.assay == "cage":
            self.soft_clip += 1  # for an untemplated G

    @property
    def clipped(self) -> int:
        """Bases cut from reads before mapping; the one that cage adds is left out in searches only."""
        return self.soft_clip - (self.assay == "cage")

    @property
    def introns(self) -> tuple[int, int] | None:
        """The least and greatest length of introns within reads."""
        return (LEAST_INTRON, self.intron) if self.assay == "rna" else None

    @property
    def untemplated(self) -> int:
        """Gs before a read that the genome may not have."""
        return int(self.assay == "cage" and self.unpaired is not None)

    def dumps(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=1)

    @classmethod
    def loads(cls, text: str) -> Config:
        values = json.loads(text)
        if values.get("assay") == "cage":
            values["soft_clip"] -= 1
        return cls(**values)
