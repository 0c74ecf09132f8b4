"""Language identification by Bayesian fusion of text, declared language, address and host.

The text gives a likelihood per language from byte trigrams. What a declared language or an address says is
learnt from how often it stands beside each language the texts were told to have. The prior of a host is smoothed
towards that of its parent (the address suffix), and that towards the whole corpus; all counts come from grouped
aggregations over every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketwise.functions.durable import broadcast_if_small
from basketwise.llm.store import kept, table
from basketwise.llm.url_filter import url_host, url_path
from basketwise.llm.words import byte_slices

LANGUAGES = ("en", "fr", "de", "es")
#: Labelled rows the trigram model is fitted on, about: rows are taken by a hash of their text.
SAMPLE_ROWS = 20_000
BINS = 1 << 16
#: Trigrams of a text aren't independent: their evidence is weighed down by this power.
TEXT_WEIGHT = 0.3
#: Rows that a host or suffix needs before its own counts weigh as much as what it is smoothed towards.
PRIOR_ROWS = 20.0
#: A text is kept if one language has at least this posterior.
LEAST_POSTERIOR = 0.5


def _classes() -> np.ndarray:
    """Letters as lower case, bytes beyond ASCII as they are, all else as one blank (0)."""
    c = np.zeros(256, dtype=np.uint32)
    c[97:123] = c[65:91] = np.arange(1, 27)
    c[128:] = np.arange(27, 155)
    return c


def trigram_bins(batch_texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bins of all trigrams with a letter, bounds per text) of slices of the batch."""
    classes = _classes()
    for first, offsets, data in byte_slices(batch_texts):
        plain = classes[data[offsets[0] : offsets[-1]]]
        lengths = np.diff(offsets)
        bounds = np.concatenate([[0], np.cumsum(lengths + 2)])  # a blank on either side of each text
        c = np.zeros(bounds[-1] + 2, dtype=np.uint32)
        c[np.arange(len(plain)) + 1 + 2 * np.repeat(np.arange(len(lengths)), lengths)] = plain
        code = (c[:-2] * np.uint32(155) + c[1:-1]) * np.uint32(155) + c[2:]
        # a trigram that reaches into the next text would start on the last blank or the last letter before it
        code[bounds[1:] - 1] = 0
        code[bounds[1:] - 2] = 0
        before = np.concatenate([[0], np.cumsum(code > 0)])
        bins = ((code[code > 0] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
        yield first, bins, before[bounds]


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = batch.column("label").to_pylist()
        for first, bins, bounds in trigram_bins(batch.column("text")):
            for i in range(len(bounds) - 1):
                of = counts.setdefault(labels[first + i], np.zeros(BINS, dtype=np.int64))
                of += np.bincount(bins[bounds[i] : bounds[i + 1]], minlength=BINS)
    for label, n in counts.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(some), pa.string()), "bin": some, "n": n[some]})


def fit_trigrams(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """(label, text) -> log likelihood of each trigram bin by language, from about ``sample_rows`` whole texts.

    Rows with another label or none aren't used. Without any labelled row all languages are alike.
    """
    usable = labelled.select("label", "text").filter(F.col("label").isin(*languages) & F.col("text").isNotNull())
    every = max(1, usable.count() // sample_rows)
    sample = usable.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counted = sample.mapInArrow(_count_trigrams, "label string, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), BINS))
    for row in counted.toLocalIterator():  # BINS rows per language at most, whatever the input
        counts[languages.index(row.label), row.bin] = row.n
    smooth = counts + 0.05 + counts.sum(axis=0) * 1e-3
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


def _likelihoods(model: np.ndarray, text_col: str, schema: pa.Schema):
    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with their number of trigrams and log likelihoods per language."""
        for batch in batches:
            n, sums = [], []
            for _, bins, bounds in trigram_bins(batch.column(text_col)):
                n.append(np.diff(bounds))
                total = np.zeros((len(bins) + 1, len(model)))
                for k, of in enumerate(model):
                    np.cumsum(of[bins], out=total[1:, k])
                sums.append(total[bounds[1:]] - total[bounds[:-1]])
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            flat = np.concatenate(sums).ravel() if sums else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(model)), pa.array(flat))
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name in schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64)), lists], [*schema.names, "_n", "_ll"])

    return likelihoods


def _softmax(logs: Column) -> Column:
    shifted = F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b)
    return F.transform(shifted, lambda v: v / total)


def _sums(columns: int) -> list[Column]:
    return [F.sum(F.col("_p")[i]).alias(f"s{i}") for i in range(columns)]


def _said_given(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(value, log P(value | language)) of an evidence column, from the languages its rows' texts have."""
    counts = kept(rows.filter(F.col(column).isNotNull()).groupBy(column).agg(*_sums(n)), "evidence")
    totals = counts.agg(F.count(F.lit(1)).alias("k"), *[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"t{i}") for i in range(n)]).first()
    logs = [F.log((F.col(f"s{i}") + 0.1) / F.lit(totals[f"t{i}"] + 0.1 * (totals["k"] + 1))) for i in range(n)]
    return broadcast_if_small(counts.select(F.col(column), F.array(*logs).alias(f"{column}_log")))


def _host_priors(rows: DataFrame, n: int) -> DataFrame:
    """(host, parent, log prior): counts of the host, smoothed by those of its parent, these by those of all rows."""
    hosts = kept(rows.filter(F.col("_host").isNotNull()).groupBy("_host", "_parent").agg(*_sums(n)), "hosts")
    all_rows = hosts.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"t{i}") for i in range(n)]).first()
    total = sum(all_rows) + n
    parents = hosts.groupBy("_parent").agg(*[F.sum(f"s{i}").alias(f"p{i}") for i in range(n)])
    of_parent = reduce(lambda a, b: a + b, [F.col(f"p{i}") for i in range(n)])
    smooth = parents.select(
        F.col("_parent").alias("_of"),
        *[((F.col(f"p{i}") + PRIOR_ROWS * (all_rows[i] + 1) / total) / (of_parent + PRIOR_ROWS)).alias(f"q{i}") for i in range(n)],
    )
    of_host = reduce(lambda a, b: a + b, [F.col(f"s{i}") for i in range(n)])
    prior = [F.log((F.col(f"s{i}") + PRIOR_ROWS * F.col(f"q{i}")) / (of_host + PRIOR_ROWS)) for i in range(n)]
    met = hosts.join(smooth, F.col("_parent").eqNullSafe(F.col("_of")))
    return broadcast_if_small(met.select("_host", F.col("_parent").alias("_of"), F.array(*prior).alias("_host_log")))


def identify(
    rows: DataFrame,
    text: Column | None,
    declared: Column,
    address: Column,
    host: Column,
    parent: Column,
    model: np.ndarray,
    keep: list[str],
    languages: tuple[str, ...] = LANGUAGES,
) -> DataFrame:
    """One row per input row: the columns of ``keep``, then (language, posterior, text_language, kept).

    ``text`` None: it is the column "text" of ``keep``. ``declared`` is what the markup says, ``address`` a code in the address, ``parent`` the suffix its hosts share;
    each may be null, which says nothing. A text without a letter (null and empty among them) has no language:
    ``language`` is "und", ``posterior`` 0, and it isn't kept. Equal posteriors go to the earlier of ``languages``. Repeated rows are
    told alike; an empty table gives no rows. Columns of ``keep`` named like a result stay, the result is renamed
    with a trailing underscore.
    """
    n = len(languages)
    given = [f"_c{i}" for i in range(len(keep))]
    base = rows.select(
        *[F.col(c).alias(g) for c, g in zip(keep, given)],
        declared.cast("string").alias("_declared"),
        address.cast("string").alias("_address"),
        host.cast("string").alias("_host"),
        parent.cast("string").alias("_parent"),
        *([] if text is None else [text.alias("_text")]),
    )
    text_col = given[keep.index("text")] if text is None else "_text"
    names = [c for c in base.columns if c != "_text"]
    ddl = [f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields if f.name in names]
    wanted = pa.schema([(name, pa.null()) for name in names])
    told = base.mapInArrow(_likelihoods(model, text_col, wanted), ", ".join([*ddl, "_n long", "_ll array<double>"]))
    weighed = F.transform("_ll", lambda v: v * TEXT_WEIGHT)
    told = kept(told.withColumn("_p", F.when(F.col("_n") > 0, _softmax(weighed))), "told")
    sure = told.select("_declared", "_address", "_host", "_parent", "_p").filter(F.col("_p").isNotNull())

    fused = told
    for column in ("_declared", "_address"):
        fused = fused.join(_said_given(sure, column, n), column, "left")
    priors = _host_priors(sure, n)
    same = (F.col("_host") == F.col("_at")) & F.col("_parent").eqNullSafe(F.col("_of"))
    fused = fused.join(priors.withColumnRenamed("_host", "_at"), same, "left")
    evidence = [weighed] + [
        F.coalesce(F.col(c), F.array(*[F.lit(0.0)] * n)) for c in ("_declared_log", "_address_log", "_host_log")
    ]
    logs = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), evidence)
    fused = fused.withColumn("_post", F.when(F.col("_n") > 0, _softmax(logs)))
    names_of = F.array(*[F.lit(x) for x in languages])

    def best(of: Column) -> Column:
        return F.when(of.isNull(), F.lit("und")).otherwise(F.element_at(names_of, F.array_position(of, F.array_max(of)).cast("int")))

    def free(name: str) -> str:
        return name if name not in keep else free(name + "_")

    posterior = F.coalesce(F.array_max("_post"), F.lit(0.0))
    return fused.select(
        *[F.col(g).alias(c) for g, c in zip(given, keep)],
        best(F.col("_post")).alias(free("language")),
        posterior.alias(free("posterior")),
        best(F.col("_p")).alias(free("text_language")),
        (posterior >= LEAST_POSTERIOR).alias(free("kept")),
    )


def identify_documents(docs: DataFrame, keep: list[str]) -> DataFrame:
    """identify() for documents (text, lang, source): the language column is what was declared, the source is the host.

    The trigram model is fitted on a sample of the documents' own declared languages.
    """
    model = fit_trigrams(docs.select(F.col("lang").alias("label"), "text"))
    none = F.lit(None).cast("string")
    text = None if "text" in keep else F.col("text")
    return identify(docs, text, F.col("lang"), none, F.col("source"), none, model, keep)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents in which a language was found, with all their columns."""
    told = identify_documents(docs, docs.columns)
    flag = told.columns[-1]
    return told.filter(F.col(flag)).select(*docs.columns)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language, posterior, and whether it is kept."""
    return identify_documents(table(spark, folder, "documents"), ["doc_id"])


def pages_language(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's language, with the markup's language, the code in the path, and host priors smoothed by suffix."""
    docs, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    model = fit_trigrams(docs.select(F.col("lang").alias("label"), "text"))
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\blang\s*=\s*["']?([a-z]{2})""", 1)), F.lit(""))
    host = F.nullif(url_host(F.col("url")), F.lit(""))
    address = F.nullif(F.regexp_extract(url_path(F.col("url")), r"^/([a-z]{2})(?:/|$)", 1), F.lit(""))
    parent = F.element_at(F.split(host, r"\."), -1)
    return identify(pages, text, declared, address, host, parent, model, ["page_id"])
