"""The generated section of each page: which pages link to it, by folder.

The section is worked out from authored links alone and put in place of an old one, before the
curated section, or at the end. The text that authors wrote stays as it is, so a second run changes nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marlstone.functions.markdown import CURATED, GENERATED, section_spans
from marlstone.operators import links


def section_text(refs: list[tuple[str, list[str]]]) -> str:
    """The section for ``(folder, stems)``; without any it says so."""
    if not refs:
        return f"## {GENERATED}\n\n_No inbound links yet._\n"
    rows = [f"\n**{folder}/**  {', '.join(sorted(f'[[{s}]]' for s in stems))}\n" for folder, stems in sorted(refs)]
    return "\n".join([f"## {GENERATED}\n", *rows]) + "\n"


def put_section(text: str, section: str) -> str:
    """The page with the section as its only generated one."""
    section = section.rstrip("\n") + "\n"
    old = section_spans(text, GENERATED)
    if old:
        kept, at = [text[: old[0][0]], section], old[0][1]
        for begin, end in old[1:]:
            kept.append(text[at:begin])
            at = end
        out = "".join([*kept, text[at:]])
        return out if out.endswith("\n") else out + "\n"
    curated = section_spans(text, CURATED)
    at = curated[0][0] if curated else len(text)
    before = text[:at].rstrip("\n")
    return (before + "\n\n" if at else "") + section + text[at:]


@F.pandas_udf(StringType())
def _put(text: pd.Series, refs: pd.Series) -> pd.Series:
    of = lambda r: [(x["folder"], list(x["refs"])) for x in r] if r is not None else []
    return pd.Series([put_section(t or "", section_text(of(r))) for t, r in zip(text, refs, strict=True)])


def rendered(pages: DataFrame) -> DataFrame:
    """``(path, text, changed)``: each page with its section. Pages with malformed frontmatter stay as they are."""
    refs = links.backlinks(pages).groupBy("path").agg(F.collect_list(F.struct("folder", "refs")).alias("all"))
    rows = pages.select("path", F.col("text").alias("old"), F.col("page.fm_error").alias("error")).join(refs, "path", "left")
    rows = rows.withColumn("text", F.when(F.col("error").isNotNull(), F.col("old")).otherwise(_put(F.when(F.col("error").isNull(), F.col("old")), "all")))
    return rows.select("path", "text", (~F.col("text").eqNullSafe(F.col("old"))).alias("changed"))
