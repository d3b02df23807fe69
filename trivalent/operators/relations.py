"""What a document says of another: the signals of its text in order of precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that say so, by relation, in order of precedence; a space is white space, | is or.
SIGNALS = {
    "SUPERSEDES": "in supersession of | supersedes | superseded | superseding | अधिक्रमण में",
    "CORRIGENDUM_TO": "shall be read as | to be read as | corrigendum | erratum | शुद्धिपत्र | शुद्धि-पत्र | के स्थान पर पढ़ा जावे | के स्थान पर समझा जावे",
    "AMENDS": "amendment | amended | hereby amend | partial modification | shall be substituted | संशोधन | संशोधित | प्रतिस्थापित किया जाता है | प्रतिस्थापित करते हुए | के स्थान पर प्रतिस्थापित",
    "ADDENDUM_TO": "addendum | supplementary guideline | addition to | shall be inserted | परिशिष्ट | अनुपूरक | अतिरिक्त दिशा-निर्देश | के पश्चात जोड़ा जाता है",
    "CLARIFIES": "clarification | clarified | for the removal of doubt | स्पष्टीकरण | स्थिति स्पष्ट की जाती है | संशय निवारण",
    "EXTENDS": "deadline extended | validity extended | last date is extended | extended up to | extended from | अंतिम तिथि बढ़ाई जाती है | अवधि विस्तार | तिथि विस्तार | बढ़ाकर",
}


def signal_pattern(phrases: str) -> str:
    return "|".join(p.strip().replace(" ", r"\s+") for p in phrases.split("|"))


def relationship(text: Column, filename: Column, citation: Column) -> tuple[Column, Column]:
    """Relation and strength: EXPLICIT if the text cites the other document too, else STRONG; a signal in the file's name alone is WEAK;
    a citation alone REFERENCES."""
    body, name = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(filename, F.lit("")))
    cited = F.coalesce(F.contains(body, F.lower(citation)) & (citation != ""), F.lit(False))
    kind, weak = F.lit(None).cast("string"), F.lit(None).cast("string")
    for relation, phrases in reversed(SIGNALS.items()):
        pattern = signal_pattern(phrases)
        kind, weak = F.when(body.rlike(pattern), relation).otherwise(kind), F.when(name.rlike(pattern), relation).otherwise(weak)
    found = F.coalesce(kind, weak, F.when(cited, "REFERENCES"))
    return found, F.when(kind.isNotNull(), F.when(cited, "EXPLICIT").otherwise("STRONG")).when(weak.isNotNull(), "WEAK").when(cited, "EXPLICIT")
