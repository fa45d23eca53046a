"""Parameters of training, retrieval and validation, and their presets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

METHODS = ("laplace_split", "laplace", "bgfreq", "rubin")


@dataclass(frozen=True)
class Params:
    """Passed explicitly to every operator; nothing reads global settings.

    A null date bound, threshold or limit means no filter; a null prior is learned.
    """

    method: str = "laplace_split"
    prior: float | None = None
    mincount: int = 0
    min_infogain: float = 0.0
    positives_only: bool = False
    type_mask: tuple[str, ...] = ()
    limit: int | None = 1000
    threshold: float | None = None
    mindate: int | None = None
    maxdate: int | None = None
    train_mindate: int | None = None
    train_maxdate: int | None = None
    folds: int = 10
    alpha: float = 0.5
    utility: float | None = None
    seed: int = 1
    space: str = "wmqia"

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"no method {self.method!r}; there are {', '.join(METHODS)}")
        if (self.limit is not None and self.limit < 0) or self.folds < 1:
            raise ValueError("limit must not be negative, folds must be positive")

    def but(self, **changes) -> Params:
        return replace(self, **changes)

    @property
    def training_dates(self) -> tuple[int | None, int | None]:
        """The background's date bounds: its own, else the query's."""
        return self.train_mindate if self.train_mindate is not None else self.mindate, self.train_maxdate if self.train_maxdate is not None else self.maxdate


#: What a job of either kind of feature uses: headings and journal only, or words too.
PRESETS = {
    "plain": Params(space="mqi", mincount=2, min_infogain=0.0, method="bgfreq"),
    "all_features": Params(space="wmqia", mincount=0, min_infogain=2e-5, method="laplace_split"),
    "export": Params(limit=10000, threshold=20.0),
}

#: Parameters of the named experiments: cross-validations, and retrievals with a limit. (Fixed values.)
EXPERIMENTS = {
    "validate_headings": Params(space="mqi", method="bgfreq", mincount=1),
    "validate_words_all": Params(space="word", method="laplace", mincount=1),
    "validate_words_selected": Params(space="word", method="laplace", mincount=4, min_infogain=2.36e-5),
    "validate_final": Params(space="wmqia", method="laplace_split", mincount=0, min_infogain=2e-5, seed=124),
    "validate_drugs": Params(space="wmqia", method="laplace_split", mincount=2, min_infogain=1e-5),
    "query_final": Params(space="wmqia", mincount=0, min_infogain=2e-5, limit=1000, threshold=0.0),
    "query_headings": Params(space="mqi", limit=1000, threshold=0.0),
    "query_drugs": Params(space="wmqia", min_infogain=1e-5, limit=2000, threshold=0.0),
    "query_small": Params(space="mqi", method="bgfreq", mincount=1, limit=1000),
}

#: Codes of feature spaces: the space and the types that are left out of it. (Fixed values.)
SPACES = {
    "iedbword": ("raw_word", ()),
    "iedbconcat": ("raw_all", ()),
    "wordfold": ("word_fold", ()),
    "wordnum": ("word_num", ()),
    "wordstrip": ("word_strip", ()),
    "wmqia": ("wmqia", ()),
    "wmqiafilt": ("wmqia_filt", ()),
    "word": ("wmqia", ("mesh", "qual", "issn", "a")),
    "author": ("wmqia", ("mesh", "qual", "issn", "w")),
    "meshqi": ("mqi", ()),
    "meshq": ("mqi", ("issn",)),
    "meshnq": ("mqi", ("qual", "issn")),
    "qual": ("mqi", ("mesh", "issn")),
    "issn": ("mqi", ("mesh", "qual")),
}
#: Further ones of the same kind.
MORE_SPACES = {
    "mesh_issn": ("mqi", ("qual",)),
    "word_mesh": ("wmqia", ("qual", "issn", "a")),
    "wmqi": ("wmqia", ("a",)),
}

#: What a task's form may hold, and its ranges. (Fixed values.)
_NAME = re.compile(r"[ a-zA-Z0-9.,;:_-]{1,30}")
_CODE = re.compile(r"[ a-zA-Z0-9.;:_-]{0,10}")


@dataclass
class Task:
    """A submitted job; ``problems`` says why it can't run."""

    dataset: str
    operation: str = "retrieval"
    ids: tuple[int, ...] = field(default_factory=tuple)
    limit: int = 1000
    minscore: float = -30.0
    numnegs: int = 50000
    mindate: int | None = None
    allfeatures: bool = False
    hidden: bool = False
    delcode: str = ""
    captcha: str | None = None
    submitted: float | None = None
    prevalence: float | None = None

    def problems(self) -> list[str]:
        found = []
        if not _NAME.fullmatch(self.dataset or ""):
            found.append("dataset: 1 to 30 letters, digits, spaces and .,;:_-")
        if not _CODE.fullmatch(self.delcode or ""):
            found.append("delcode: up to 10 letters, digits, spaces and .;:_-")
        if self.operation not in ("retrieval", "validation"):
            found.append("operation: retrieval or validation")
        for name, low, high in (("limit", 100, 10000), ("minscore", -1000, 1000), ("numnegs", 100, 100000)):
            if not low <= getattr(self, name) <= high:
                found.append(f"{name}: {low} to {high}")
        if self.operation == "validation" and len(self.ids) < 30:
            found.append("ids: at least 30 for validation")
        return found

    def params(self) -> Params:
        preset = PRESETS["all_features" if self.allfeatures else "plain"]
        return preset.but(limit=self.limit, threshold=self.minscore, mindate=self.mindate)


TASK_KEYS = tuple(f.name for f in fields(Task) if f.name != "ids")
