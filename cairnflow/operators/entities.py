"""Names of people, places and bodies in transcripts put right by a lexicon, with what was found where as evidence; the text itself stays."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    canonical: str
    variants: tuple[str, ...]
    kind: str = "other"
    confidence: float = 0.95


# Names that transcripts have in other spellings.
RULES = (
    Rule("Barış Manço", ("Barış Mango", "Baris Mango", "Barış Manco", "Baris Manco", "Barış Março", "Baris Março"), "person"),
    Rule("TRT Haber", ("Trt Haber", "TRT haber", "trt haber"), "organization"),
    Rule("Mostar Köprüsü", ("Mostar Koprusu", "Mostar Köprusu", "Mostar köprüsü"), "place"),
    Rule("Neretva", ("Neretba", "Neretfa", "Neretwa"), "place"),
)
_FOUND = "array<struct<canonical:string,kind:string,matched:string,start:int,end:int,confidence:double>>"


def found_in(text: str, rules: tuple[Rule, ...]) -> tuple[str, list[tuple]]:
    """The text with each variant, as whole words in any case, made canonical, rule by rule; and what was changed, with its place in the text as
    it stood when its variant's turn came."""
    out: list[tuple] = []
    for rule in rules:
        for variant in rule.variants:
            parts, at = [], 0
            for m in re.finditer(rf"(?<!\w){re.escape(variant)}(?!\w)", text, re.IGNORECASE):
                parts += [text[at : m.start()], rule.canonical]
                at = m.end()
                if m[0] != rule.canonical:
                    out.append((rule.canonical, rule.kind, m[0], m.start(), m.end(), rule.confidence))
            text = "".join(parts) + text[at:]
    return text, out


def normalised(rows: DataFrame, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rows with normalized_text (null where nothing changed) and entities.  Only texts in which Spark finds a variant's words are looked at closer."""
    variants = [v for r in rules for v in r.variants]
    if not variants:
        return rows.withColumns({"normalized_text": F.lit(None).cast("string"), "entities": F.array().cast(_FOUND)})
    # the dotless and dotted i are one letter to no engine alike: any character may stand for them here
    some = "|".join(sorted({re.sub(r"[iıİIKſkKSsÅå]", ".", re.escape(v).replace("\\ ", " ")) for v in variants}))

    @F.pandas_udf(f"text string, found {_FOUND}")
    def look(t: pd.Series) -> pd.DataFrame:
        got = [found_in(x, rules) if x is not None else (None, []) for x in t]
        names = ("canonical", "kind", "matched", "start", "end", "confidence")
        return pd.DataFrame({"text": [x for x, _ in got], "found": [[dict(zip(names, e)) for e in f] for _, f in got]})

    d = rows.withColumn("_some", F.coalesce(F.col(text).rlike(f"(?iu){some}"), F.lit(False)))
    near = d.where("_some").withColumn("_l", look(text))
    changed = near["_l.text"] != near[text]
    near = near.withColumns({"normalized_text": F.when(changed, F.col("_l.text")), "entities": F.when(changed, F.col("_l.found")).otherwise(F.array().cast(_FOUND))}).drop("_l", "_some")
    rest = d.where("NOT _some").drop("_some").withColumns({"normalized_text": F.lit(None).cast("string"), "entities": F.array().cast(_FOUND)})
    return near.unionByName(rest)
