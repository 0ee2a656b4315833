"""SQL surface: functions, table functions and data sources registered in a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import StringType

from .functions.htmltree import TEXT_BLOCKS, Reader, Tree
from .sources.payloads import transcript
from .sources.web import WebSource


@pandas_udf(StringType())
def html_markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda x: Tree(x or "").markdown())


@pandas_udf(StringType())
def html_title(html: pd.Series) -> pd.Series:
    return html.map(lambda x: Reader(x or "").read()[0])


@pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(lambda x: Reader(x or "").read()[1])


@pandas_udf(StringType())
def vtt_transcript(vtt: pd.Series) -> pd.Series:
    return vtt.map(lambda x: transcript(x or ""))


@udtf(returnType="ord int, path string, tag string, text string")
class HtmlBlocks:
    """Blocks with text of one page: SELECT b.* FROM pages, LATERAL html_blocks(html) b"""

    def eval(self, html: str):
        t = Tree(html or "")
        k = 0
        for n in t.below(0):
            if t.tag[n] in TEXT_BLOCKS and (text := t.text(n)):
                yield k, t.path[n], t.tag[n], text
                k += 1


@udtf(returnType="path string, text string")
class HtmlSelect:
    """Elements of one page that a selector finds, in document order."""

    def eval(self, html: str, selector: str):
        t = Tree(html or "")
        for n in t.select(selector or ""):
            yield t.path[n], t.text(n)


def register(spark: SparkSession) -> None:
    for name, f in (("html_markdown", html_markdown), ("html_title", html_title), ("html_text", html_text), ("vtt_transcript", vtt_transcript)):
        spark.udf.register(name, f)
    spark.udtf.register("html_blocks", HtmlBlocks)
    spark.udtf.register("html_select", HtmlSelect)
    spark.dataSource.register(WebSource)
    # plain expressions as SQL functions
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION is_sha256(s STRING) RETURNS BOOLEAN RETURN coalesce(s RLIKE '\\A[0-9a-f]{64}\\z', false)")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION content_hash(s STRING) RETURNS STRING RETURN sha2(s, 256)")


