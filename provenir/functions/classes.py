"""What classes are called where a graph view names them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of classes.
CLASS_LABELS = {
    "Q482994": "album",
    "Q105543609": "musical work/composition",
    "Q134556": "single",
    "Q11424": "film",
    "Q55850593": "music track with vocals",
    "Q55850643": "music track without lyrics",
    "Q7302866": "audio track",
    "Q108352496": "single release",
    "Q7366": "song",
    "Q7725634": "literary work",
    "Q47461344": "written work",
    "Q1980247": "chapter",
    "Q17489659": "group of works",
    "Q21191270": "television series episode",
    "Q5398426": "television series",
    "Q3464665": "television series season",
    "Q15416": "television program",
    "Q1261214": "television special",
    "Q506240": "television film",
    "Q1259759": "miniseries",
    "Q110039749": "Saturday Night Live sketch",
    "Q24862": "short film",
    "Q202866": "animated film",
    "Q18011172": "film project",
    "Q193977": "music video",
    "Q10590726": "video album",
    "Q58483083": "dramatico-musical work",
    "Q15079786": "ballet",
    "Q17517379": "animated short film",
    "Q3331189": "version, edition or translation",
    "Q169930": "extended play",
    "Q6128115": "7″ single",
    "Q140727568": "comic book issue",
    "Q7889": "video game",
    "Q5": "human",
    "Q215380": "musical group",
    "Q5741069": "rock band",
    "Q15632617": "fictional human",
    "Q3658341": "literary character",
    "Q15773347": "film character",
    "Q15773317": "television character",
    "Q15711870": "animated character",
    "Q182832": "concert",
    "Q1573906": "concert tour",
    "Q273057": "discography",
    "Q618779": "award",
    "Q38033430": "class of award",
    "Q107655869": "group of awards",
    "Q1364556": "music award",
    "Q378427": "literary award",
    "Q11448906": "science award",
    "Q104635718": "Wikimedia artist discography",
    "Q13433827": "encyclopedia article",
    "Q19389637": "biographical article",
}
NO_CLASS = "no stated class"


def describe_classes(classes: Column) -> Column:
    """The names of an array of classes, comma-separated; a class without a name stands for itself."""
    names = F.create_map(*(F.lit(x) for pair in CLASS_LABELS.items() for x in pair))
    said = F.transform(classes, lambda c: F.coalesce(F.try_element_at(names, c), c))
    return F.when(F.coalesce(F.size(classes), F.lit(0)) > 0, F.array_join(said, ", ")).otherwise(NO_CLASS)
