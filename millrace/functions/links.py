"""Model links and repository shorthands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import strip

# Path words that separate a repository from a revision.
REVISION_WORDS = ("resolve", "blob", "raw")
DEFAULT_REVISION = "main"


def parse_repo_refs(df: DataFrame, link: str = "link") -> DataFrame:
    """Add ``repo_id``, ``revision``, ``file``, ``is_gguf`` and ``ok`` for each link."""
    clean = F.rtrim(strip(F.col(link)), F.lit("/"))
    is_url = F.col("_clean").startswith("http://") | F.col("_clean").startswith("https://")
    # the path ends at the first ; ? or #, and starts after scheme and host
    path = F.when(is_url, F.regexp_extract("_clean", r"^https?://[^/?#]*([^?#]*)", 1)).otherwise(F.col("_clean"))
    path = F.when(is_url, F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)
    parts = F.filter(F.split(path, "/"), lambda part: part != "")
    n = F.size("_parts")
    word = F.array_min(
        F.filter(
            F.transform(F.array(*[F.lit(w) for w in REVISION_WORDS]), lambda w: F.array_position("_parts", w)),
            lambda at: at > 0,
        )
    )

    def joined(start: Column | int, length: Column) -> Column:
        start = F.lit(start) if isinstance(start, int) else start
        return F.array_join(F.slice("_parts", start, F.greatest(length, F.lit(0))), "/")

    at = F.col("_word").cast("int")
    last = F.element_at("_parts", -1)
    gguf_short = (n >= 3) & last.endswith(".gguf")
    url_repo = F.when(at.isNotNull(), joined(1, at - 1)).otherwise(joined(1, F.lit(2)))
    short_repo = F.when(gguf_short, joined(1, n - 1)).when((n == 1) | (n == 2), joined(1, n))
    repo = F.when(F.col("_url"), F.when(n >= 2, url_repo).when(n == 1, joined(1, F.lit(1)))).otherwise(short_repo)
    split_at = F.col("_url") & (n >= 2) & at.isNotNull()
    revision = F.when(split_at & (n > at), F.get("_parts", at)).otherwise(F.lit(DEFAULT_REVISION))
    file = F.when(split_at & (n > at + 1), joined(at + 2, n - at - 1)).when(~F.col("_url") & gguf_short, last)
    ok = F.coalesce(F.col("repo_id") != "", F.lit(False))
    return (
        df.withColumn("_clean", clean)
        .withColumns({"_url": is_url, "_parts": parts})
        .withColumn("_word", word)
        .withColumns({"repo_id": repo, "revision": revision, "file": file})
        .withColumn("ok", ok)
        .withColumns({
            "repo_id": F.when(F.col("ok"), F.col("repo_id")),
            "revision": F.when(F.col("ok"), F.col("revision")),
            "file": F.when(F.col("ok"), F.col("file")),
            "is_gguf": F.when(F.col("ok"), F.coalesce(F.col("file").endswith(".gguf"), F.lit(False))),
        })
        .drop("_clean", "_url", "_parts", "_word")
    )
