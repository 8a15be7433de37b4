"""Dashboard aggregates, votes, savings and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def zero() -> Column:
    return F.lit(0).cast("long")


#: Votes of an extension, a shebang line and a manifest.
VOTES = {"extension": 1, "shebang": 20, "manifest": 100}
#: Dollars for a million tokens saved, bytes of a token, share and price of the estimate.
SAVED_USD, TOKEN_BYTES, SHARE, PRICE_USD = 0.30, 4, 0.308, 3.0


def totals(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("byte_size"), zero()).alias("bytes"))
    return f.crossJoin(symbols.agg(F.count("*").alias("symbols"))).crossJoin(refs.agg(F.count("*").alias("refs")))  # one row each


def repo_details(repos: DataFrame, files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Counts of every repository, also of those without files; each child is counted by file before it is joined."""
    owner = files.select("file_id", "repo_id")

    def by_repo(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("file_id").agg(F.count("*").alias("n")).join(owner, "file_id").groupBy("repo_id").agg(F.sum("n").alias(name))

    own = files.groupBy("repo_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("byte_size"), zero()).alias("bytes"))
    out = repos.select("repo_id", F.col("name").alias("repo")).join(own, "repo_id", "left").join(by_repo(symbols, "symbols"), "repo_id", "left").join(by_repo(refs, "refs"), "repo_id", "left")
    return out.select("repo", *(F.coalesce(c, zero()).alias(c) for c in ("files", "bytes", "symbols", "refs")))


def languages(files: DataFrame, symbols: DataFrame, top: int = 20) -> DataFrame:
    by_file = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    joined = files.join(by_file, "file_id", "left").groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), zero()).alias("symbols"))
    return joined.orderBy(F.desc("files"), "language").limit(top)


def symbol_kinds(symbols: DataFrame, top: int = 12) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(top)


def largest_files(files: DataFrame, symbols: DataFrame, top: int = 12) -> DataFrame:
    """The top rows are taken before symbols are counted for them."""
    best = files.orderBy(F.desc("byte_size"), "path").limit(top).select("file_id", "path", "language", "byte_size")
    n = symbols.join(best.select("file_id"), "file_id", "left_semi").groupBy("file_id").agg(F.count("*").alias("symbols"))
    return best.join(n, "file_id", "left").select("path", "language", "byte_size", F.coalesce("symbols", zero()).alias("symbols"))


def confidence(votes: DataFrame) -> DataFrame:
    """votes (language, how, files): score and share of all scores."""
    weight = F.create_map(*[F.lit(x) for pair in VOTES.items() for x in pair])
    scored = votes.groupBy("language").agg(F.sum(weight[F.col("how")] * F.col("files")).alias("score"), F.sum(F.when(F.col("how") != "manifest", F.col("files")).otherwise(zero())).alias("files"))
    return scored.withColumn("confidence", F.col("score") / F.sum("score").over(Window.partitionBy()))  # as many rows as languages


def savings(log: DataFrame) -> DataFrame:
    """Log rows (repo, session, ts, calls, avoided, returned, saved) rolled up by repository."""
    out = log.groupBy("repo").agg(
        F.sum("calls").alias("calls"), F.sum("avoided").alias("avoided"), F.sum("returned").alias("returned"), F.sum("saved").alias("saved"),
        F.max("ts").alias("last_ts"), F.countDistinct("session").alias("sessions"),
    )
    return out.withColumn("usd", F.round(F.col("saved") / 1e6 * SAVED_USD, 9))


def savings_by_folder(log: DataFrame, earlier: DataFrame) -> DataFrame:
    """Log rows (folder, seq, repo, session, ts, calls, avoided, returned, saved), one log to a folder, and the aggregates
    (folder, ts, calls, avoided, returned, saved) that older versions left there: sums of both.  A folder's repository is the
    first non-empty name by ``seq``, else what follows the last underscore of the folder's name."""
    kept = ["folder", "ts", "calls", "avoided", "returned", "saved"]
    none = F.lit(None)
    before = earlier.select(*kept, none.cast("long").alias("session"), none.cast("long").alias("seq"), none.cast("string").alias("repo"))
    named = F.when(F.col("repo") != "", F.struct("seq", "repo"))
    out = log.select(*before.columns).unionByName(before).groupBy("folder").agg(
        F.min(named).alias("named"), *(F.coalesce(F.sum(c), zero()).alias(c) for c in ("calls", "avoided", "returned", "saved")),
        F.coalesce(F.max("ts"), zero()).alias("last_ts"), F.countDistinct("session").alias("sessions"),
    )
    repo = F.coalesce(F.col("named.repo"), F.element_at(F.split("folder", "_"), -1))
    return out.withColumns({"repo": repo, "usd": F.round(F.col("saved") / 1e6 * SAVED_USD, 9)}).drop("named")


def savings_overall(rolled: DataFrame) -> DataFrame:
    own = rolled.where("calls > 0")
    return own.agg(F.coalesce(F.sum("calls"), zero()).alias("calls"), F.coalesce(F.sum("saved"), zero()).alias("saved"), F.count("*").alias("repos"))


def economics(sizes: DataFrame, size: str = "byte_size") -> DataFrame:
    """Rounded estimate of tokens and cost from bytes."""
    tokens = F.round(F.col(size) / TOKEN_BYTES).cast("long")
    avoided = F.round(tokens * SHARE).cast("long")
    return sizes.withColumns({"tokens": tokens, "avoided": avoided, "usd": F.round(avoided * PRICE_USD / 1e6, 9)})


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row that doesn't depend on order or partitioning: number of rows and sums of parts of their hashes, 24 bits each, so
    that the sums hold for 5e11 rows."""
    text = F.concat_ws("␟", *(F.coalesce(F.col(c).cast("string"), F.lit("␀")) for c in columns))
    h = F.sha2(text, 256)
    part = lambda i: F.conv(F.substring(h, i, 6), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(part(1 + 6 * k)), zero()).alias(f"h{k}") for k in range(8)))


def adoption(calls: DataFrame) -> DataFrame:
    """calls (tool, used): the whole percentage of tools that were used at least once."""
    own = calls.groupBy("tool").agg(F.bool_or("used").alias("used"))
    return own.agg(F.expr("count_if(used) * 100 div count(*)").alias("percent"))
