"""Options of the mapping, their defaults and checks, and what can be told from a file's header."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: K-mer length of the pore's model by (pore, rna).
KMER_LENGTHS = {("r9", False): 6, ("r9", True): 5, ("r10", False): 9, ("rna004", True): 9}
#: The model table by (pore, rna).  There is no RNA on r10; DNA that is said to be of the RNA pore takes the r10 table.
MODELS = {("r9", False): "dna_r9", ("r9", True): "rna_r9", ("r10", False): "dna_r10", ("rna004", False): "dna_r10", ("rna004", True): "rna_rna004"}
LEAST_EVENTS = 25
CANDIDATES = 5


@dataclass(frozen=True)
class MapOptions:
    rna: bool = False
    pore: str = "r9"
    prefix: int = 50  # events skipped; negative: look for adaptor and poly-A
    query: int = 250  # events aligned
    from_end: bool = False
    full_ref: bool = False
    invert: bool = False
    standard: bool = False  # global instead of subsequence alignment
    sam: bool = False
    rna_letters: bool = False
    candidates: int = CANDIDATES
    reference_bytes: int = 1 << 28  # of levels that one broadcast may hold, if no tile is larger
    tile_columns: int = 1 << 24  # of a reference that one row may hold; longer ones are cut

    def __post_init__(self) -> None:
        if self.pore not in ("r9", "r10", "rna004"):
            raise ValueError(f"unknown pore: {self.pore}")
        if not self.rna and (self.standard or self.invert or self.full_ref):
            raise ValueError("standard alignment, inversion and full references are for RNA")
        if self.rna and self.pore == "r10":
            raise ValueError("there is no RNA model for this pore")
        if self.prefix < 0 and (not self.rna or self.invert or self.from_end):
            raise ValueError("a prefix can be looked for in RNA from the read's start only")
        if self.tile_columns < 1:
            raise ValueError("a tile needs at least one column")
        if self.query < 1:
            raise ValueError("the query needs at least one event")

    @property
    def kmer_length(self) -> int:
        return KMER_LENGTHS.get((self.pore, self.rna), 9)


def model_name(pore: str, rna: bool) -> str:
    """The table of a registry (a folder of ``NAME.model`` files) that a pore and kind of molecule take."""
    if (pore, rna) not in MODELS:
        raise ValueError(f"there is no {'RNA' if rna else 'DNA'} model for {pore}")
    return MODELS[pore, rna]


def model_choice(pore: Column | str, rna: Column | str) -> Column:
    """``model_name`` for columns; null where there is none."""
    pairs = F.create_map(*[F.lit(x) for (p, r), name in MODELS.items() for x in (f"{p} {str(r).lower()}", name)])
    return F.try_element_at(pairs, F.concat_ws(" ", pore, F.col(rna).cast("string") if isinstance(rna, str) else rna.cast("string")))


def is_rna(experiment_type: Column | str) -> Column:
    """From the header's experiment type; DNA for anything but ``rna``."""
    c = F.col(experiment_type) if isinstance(experiment_type, str) else experiment_type
    return F.coalesce(c == "rna", F.lit(False))


def pore_of(sequencing_kit: Column | str) -> Column:
    c = F.lower(F.col(sequencing_kit) if isinstance(sequencing_kit, str) else sequencing_kit)
    return F.when(F.contains(c, F.lit("114")), "r10").when(F.contains(c, F.lit("rna004")), "rna004").otherwise("r9")


def parse_size(s: str) -> int:
    """``20M`` and the like: decimal multiples."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?)([KkMmGg]?)[Bb]?\s*", s)
    if not m:
        raise ValueError(f"not a size: {s}")
    return int(float(m[1]) * {"": 1, "k": 10**3, "m": 10**6, "g": 10**9}[m[2].lower()] + 0.499)


def yes_or_no(s: str) -> bool:
    if s.lower() in ("yes", "y"):
        return True
    if s.lower() in ("no", "n"):
        return False
    raise ValueError(f"yes or no: {s}")


def size_text(n: float) -> str:
    for unit in ("B", "kB", "MB", "GB", "TB"):
        if abs(n) < 1000 or unit == "TB":
            return f"{n:.1f} {unit}"
        n /= 1000
    raise AssertionError
