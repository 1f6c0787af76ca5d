"""Names, types and parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

CLASS = ["v_gene", "j_gene", "cdr3_length"]
WORKING = ["sequence_id", "v_gene", "j_gene", "cdr3_length", "cdr3", "alt_sequence_alignment", "alt_germline_alignment", "mutation_count"]
ROW = "_row"
#: The gene of the rows that stand for all classes of one length.
ANY = "None"


@dataclass(frozen=True)
class Params:
    """Settings of the inference.

    precision is lowered by 1e-4 before use. alignment_length is the number of letters of the alignments (None: the longest in
    the data). exact: exact thresholds of the mutation statistic in place of a Monte Carlo draw of ``draws``.
    error_of_own_fit: goodness of each fit from its own parameters (False: both from the geometric fit's).
    """

    precision: float = 1.0
    sensitivity: float = 0.9
    min_length: int = 15
    max_length: int = 81
    nmax: int = 100_000
    seed: int = 0
    alignment_length: int | None = None
    inclusive: bool = True
    exact: bool = True
    draws: int = 1_000_000
    error_of_own_fit: bool = True
    xy_offset: float = 0.0
    xy_constant: float | None = None

    def legal(self, length: str = "cdr3_length") -> str:
        """SQL for the lengths that are modelled."""
        return f"{length} between {self.min_length} and {self.max_length} and {length} % 3 = 0"


PAIRED = {"min_length": 57, "max_length": 144}
