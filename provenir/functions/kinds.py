"""The kind of an entity by the classes it states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes of each kind; of kinds that disagree the first here counts.
KIND_CLASSES = {
    "PERSON": ["Q5"],
    "WORK": [
        "Q11424", "Q482994", "Q7725634", "Q571", "Q134556", "Q7366", "Q5398426", "Q47461344", "Q3305213", "Q2431196",
        "Q105543609", "Q21191270", "Q110039749", "Q506240", "Q24862", "Q1261214", "Q15416", "Q58483083", "Q55850593",
        "Q193977", "Q1259759", "Q202866", "Q10590726", "Q3331189", "Q169930", "Q6128115", "Q17517379", "Q7302866",
        "Q108352496", "Q140727568", "Q7889",
    ],
    "GROUP": [
        "Q215380", "Q43229", "Q2088357", "Q4830453", "Q891723", "Q5741069", "Q9212979", "Q19351429", "Q42998", "Q131186",
        "Q1538570", "Q207338", "Q163740", "Q16334295", "Q13473501", "Q414147", "Q56816954", "Q18510489", "Q178790",
    ],
    "EVENT": ["Q1656682", "Q182832", "Q132241", "Q198", "Q1573906"],
    "PLACE": ["Q515", "Q6256", "Q532", "Q3957", "Q35657", "Q82794"],
}


def kind_of(classes: Column) -> Column:
    """The most decisive kind that any of the classes has, in whatever order they come; CONCEPT without one, or for null."""
    known = [F.when(F.arrays_overlap(classes, F.array(*map(F.lit, ids))), F.lit(kind)) for kind, ids in KIND_CLASSES.items()]
    return F.coalesce(*known, F.lit("CONCEPT"))


def rederive(kind: Column, classes: Column) -> Column:
    """The kind by the classes where any are stated, even if that is CONCEPT; else the kind as it was claimed."""
    return F.when(F.size(classes) > 0, kind_of(classes)).otherwise(kind)
