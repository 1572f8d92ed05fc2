"""Quality rules, and verdicts on hosts from how often their documents fail.

DataFrame functions only. A document is measured where it lies; a small row a
document is written, and hosts are judged from sums of these rows.

Cases: a null text counts as empty (no words, so it fails the word rule);
documents without a host are judged by themselves; repeated rows each count;
other columns pass through in ``row``; an empty input gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import BLANK_CHARS, BLANKS, Workspace, let

#: Characters that count as symbols (fixed by the rule's definition).
SYMBOLS = "#*$%&|<>"
#: Words in a window of repetition.
WINDOW = 8


def measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, all long."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, f"[{BLANKS}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANK_CHARS, "") != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(t, BLANK_CHARS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": let(F.transform(words, lambda w: F.xxhash64(w)), repeat_words),
    }


def repeat_words(hashes: Column) -> Column:
    """Words that lie in a window of WINDOW words which is there twice or more.

    Windows are compared by a 64-bit hash of their words' hashes. Texts without
    a repeated window stop at a count of distinct ones; in others the windows
    are sorted, and the union of the repeated ones is measured in one pass.
    """
    n = F.size(hashes)
    windows = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    )

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(
                F.transform(
                    s,
                    lambda e, j: F.when(
                        (F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"]), e["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return F.aggregate(
                F.sort_array(again),
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda acc, i: F.struct(
                    (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")
                ),
                lambda acc: acc["n"],
            )

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ordered, starts))

    return F.when(n < WINDOW, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def host_rules(
    docs: DataFrame,
    ws: Workspace,
    host: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_host_rate: float = 0.5,
    keep: list[str] | None = None,
) -> DataFrame:
    """A row a document: ``row`` (struct of ``keep``, or of all columns), the measures, base_failed, host_docs, host_failed, host_rate, kept.

    A host's failure rate is shrunk towards that of all hosts: with a beta prior
    fitted to the hosts' rates by moments, (failed + a) / (docs + a + b). A
    document is kept if it passes its own rules and its host's shrunk rate is at
    most ``max_host_rate``.

    Hosts are summed where the rows lie before anything moves, so a host with a
    third of all documents costs one row a task; verdicts meet the documents in a
    join that the engine can split on a hot host, and broadcasts when it has
    measured the table to be small.
    """
    kept = docs.columns if keep is None else keep
    m = measures(F.col(text_col))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    measured = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.cast("string").alias("host"), *[c.alias(n) for n, c in m.items()]
    ).withColumn("base_failed", failed)
    measured = ws.save(measured, "measured")
    hosts = measured.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")
    )
    hosts = ws.save(hosts, "hosts")
    a, b = beta_prior(hosts)
    rate = (F.col("host_failed") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b))
    judged = measured.join(hosts.withColumn("host_rate", rate), "host", "left")
    fine = F.coalesce(F.col("host_rate") <= max_host_rate, F.lit(True))
    return judged.select("row", *m, "base_failed", "host_docs", "host_failed", "host_rate", (~F.col("base_failed") & fine).alias("kept"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta prior of the hosts' failure rates by moments; one row comes to the driver.

    With fewer than two hosts, or rates that do not vary, the prior counts as
    one document at the mean rate. Its weight is kept within 1 and 1,000,000.
    """
    rate = F.col("host_failed") / F.col("host_docs")
    mean, var = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    mean = min(max(mean or 0.0, 1e-6), 1 - 1e-6)
    weight = mean * (1 - mean) / var - 1 if var else 1.0
    weight = min(max(weight, 1.0), 1e6)
    return mean * weight, (1 - mean) * weight


RULES_SQL = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS x,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, ws[i:i + 7] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM t WHERE len(ws) >= 8)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM repeated) GROUP BY doc_id
), measured AS (
  SELECT t.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda s: length(s))), 0) AS BIGINT) AS word_chars,
    CAST(length(x) - length(translate(x, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN covered c ON t.doc_id = c.doc_id
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
), hosts AS (
  SELECT source, count(*) AS host_docs, CAST(count(*) FILTER (WHERE base_failed) AS BIGINT) AS host_failed
  FROM failed WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT least(greatest(avg(host_failed / host_docs), 1e-6), 1 - 1e-6) AS m, var_samp(host_failed / host_docs) AS v FROM hosts
), prior AS (
  SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1.0 END AS k FROM moments
)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
       NOT f.base_failed AND coalesce((h.host_failed + m * k) / (h.host_docs + k) <= 0.5, true) AS kept,
       h.host_docs, h.host_failed
FROM failed f LEFT JOIN hosts h ON f.source = h.source, prior
"""
