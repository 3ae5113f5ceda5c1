"""Failure mining: clusters of failures, and the guards synthesised from them. Input is the failures table (sources.logs.FAILURES)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import numbered, staged

#: Characters of the candidate spans.
SHORTEST, LONGEST = 8, 29
#: Rows that are Python values at a time; spans that a task counts before it hands them on; spans that texts are searched for at once.
SLICE_ROWS, HELD, SPANS = 64, 200_000, 100_000
WORDS = r"(?Ud)(\w+)"


def asr_by(failures: DataFrame, *by: str) -> DataFrame:
    """Size and attack success rate of each group."""
    return failures.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("was_violation").cast("double")), F.lit(0.0)).alias("asr"))


def cluster_text() -> Column:
    return F.concat(F.col("input"), F.lit("\n"), F.col("output"))


def first_word_clusters(failures: DataFrame) -> DataFrame:
    """Adds label: the number of the text's first word, words numbered as they first appear by idx."""
    word = F.coalesce(F.nullif(F.regexp_extract(F.lower(cluster_text()), WORDS, 1), F.lit("")), F.lit("_"))
    words = failures.select(word.alias("_w"), "idx").groupBy("_w").agg(F.min("idx").alias("_first"))
    numbers = numbered(words, "label", F.col("_first"), F.col("_w")).select("_w", F.col("label").cast("int").alias("label"))
    return failures.withColumn("_w", word).join(numbers, "_w").drop("_w")


def kmeans_clusters(failures: DataFrame, features: str | None = None, min_cluster_size: int = 5, method: str = "kmeans", seed: int = 0) -> DataFrame:
    """Adds label by (bisecting) k-means over given vectors, or over TF-IDF of the text; k from the number of rows as n / min size, 2 to 20."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer, StopWordsRemover
    from pyspark.ml.functions import array_to_vector

    k = max(2, min(failures.count() // min_cluster_size, 20))
    km = (BisectingKMeans if method == "bisecting" else KMeans)(k=k, seed=seed, featuresCol="_f", predictionCol="label")
    if features:
        df = failures.withColumn("_f", array_to_vector(F.col(features).cast("array<double>")))
        return km.fit(df).transform(df).drop("_f")
    df = failures.withColumn("_t", cluster_text())
    stages = [RegexTokenizer(inputCol="_t", outputCol="_a", pattern=r"\W+"), StopWordsRemover(inputCol="_a", outputCol="_b"), CountVectorizer(inputCol="_b", outputCol="_c", vocabSize=2048), IDF(inputCol="_c", outputCol="_d"), Normalizer(inputCol="_d", outputCol="_f"), km]
    return Pipeline(stages=stages).fit(df).transform(df).drop("_t", "_a", "_b", "_c", "_d", "_f")


def clusters(labelled: DataFrame) -> DataFrame:
    """label, n, asr, ord: the clusters from the largest down, noise (-1) dropped; ties as they first appear."""
    rows = labelled.where("label <> -1").groupBy("label").agg(F.count("*").alias("n"), F.avg(F.col("was_violation").cast("double")).alias("asr"), F.min("idx").alias("first_idx"))
    return numbered(rows, "ord", F.desc("n"), F.col("first_idx")).withColumn("ord", F.col("ord") + 1)


def _span(n: int):
    return lambda i: F.struct(F.lit(n).alias("k"), i.alias("i"), F.array_join(F.slice("w", i, n), " ").alias("p"))


def phrases(labelled: DataFrame, samples: int = 8, chars: int = 300, top: int = 3) -> DataFrame:
    """label, summary: the commonest 2- and 3-word phrases of each cluster's first samples; ties as they first occur."""
    per = Window.partitionBy("label").orderBy("idx")
    first = labelled.withColumn("_s", F.row_number().over(per)).where(F.col("_s") <= samples).select("label", "_s", F.regexp_extract_all(F.lower(F.substring("input", 1, chars)), F.lit(WORDS), 1).alias("w"))
    each = None
    for n in (2, 3):
        spans = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), _span(n))
        part = first.where(F.size("w") >= n).select("label", "_s", F.explode(spans).alias("x")).select("label", "_s", "x.*")
        each = part if each is None else each.unionByName(part)
    counted = each.groupBy("label", "p").agg(F.count("*").alias("c"), F.min(F.struct("_s", "k", "i")).alias("at"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("c"), "at"))).where(F.col("r") <= top)
    tops = ranked.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p"))), lambda x: x["p"]), ", ").alias("top"))
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.join(tops, "label", "left").select("label", F.concat(F.col("n").cast("string"), F.lit(" failures; common phrases: "), F.coalesce("top", F.lit(""))).alias("summary"))


def positives(labelled: DataFrame) -> DataFrame:
    return labelled.where("was_violation").select("label", "idx", F.concat(F.col("input"), F.lit(" "), F.col("output")).alias("text"))


def _each(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of all batches, few of them at a time as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield from zip(*(batch.column(c).slice(at, SLICE_ROWS).to_pylist() for c in columns))


def _tallied(batches: Iterator[pa.RecordBatch], size: int, extending: bool) -> Iterator[pa.RecordBatch]:
    """label, least, span, n, place: how often, and where first, the spans of size characters occur; counts of a task's parts are added up later.

    Extending, only spans count that begin with one of the row's heads and are longer than it; they are shorter than size at the end of a text.
    """
    held: dict[tuple, dict[str, list]] = {}
    many = 0

    def told() -> pa.RecordBatch:
        rows = [(label, least, span, n, place) for (label, least), found in held.items() for span, (n, place) in found.items()]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["label", "least", "span", "n", "place"])

    for label, least, place, text, heads in _each(batches, "label", "least", "place", "t", "heads"):
        found = held.setdefault((label, least), {})
        many -= len(found)
        if extending:
            known, short = set(heads), len(heads[0])
            spans = ((i, text[i : i + size]) for i in range(len(text) - short) if text[i : i + short] in known)
        else:
            spans = ((i, text[i : i + size]) for i in range(len(text) - size + 1))
        for i, span in spans:
            got = found.get(span)
            if got is None:
                found[span] = [1, place + i]
            else:
                got[0] += 1
                if place + i < got[1]:
                    got[1] = place + i
        many += len(found)
        if many > HELD:
            yield told()
            held, many = {}, 0
    if many:
        yield told()


def _prefixes(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    """label, span, n, place: every prefix longer than shortest of the counted spans, which come in order, if it occurs more than least times."""
    rows: list[tuple] = []
    here, last, last_least, open_ = None, "", 0, []  # open_: count and first place of each prefix of last, from shortest + 1 characters

    def close(to: int) -> None:
        while len(open_) > max(to - shortest, 0):
            n, place = open_.pop()
            if n > last_least:
                rows.append((here, last[: shortest + 1 + len(open_)], n, place))
            if open_:
                open_[-1] = (open_[-1][0] + n, min(open_[-1][1], place))

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["label", "span", "n", "place"])
        rows.clear()
        return out

    for label, least, span, n, place in _each(batches, "label", "least", "span", "n", "place"):
        same = 0
        if label == here:
            while same < min(len(last), len(span)) and last[same] == span[same]:
                same += 1
        close(same)
        if len(rows) > HELD:
            yield told()
        here, last, last_least = label, span, least
        open_ += [(0, 1 << 63)] * (len(span) - shortest - len(open_))
        open_[-1] = (open_[-1][0] + n, min(open_[-1][1], place))
    close(0)
    if rows:
        yield told()


_COUNTED = "label long, least long, span string, n long, place long"


def _candidate_spans(texts: DataFrame, shortest: int, longest: int, keep: int) -> DataFrame:
    """candidate_spans of texts (label, idx, t: lower-cased) that can be read again and again."""
    order = numbered(texts.select("idx").distinct(), "_rank", F.col("idx"))
    rows = texts.where(F.length("t") >= shortest).join(order, "idx").select(F.col("label").cast("long").alias("label"), (F.col("_rank") * (1 << 32)).alias("place"), "t")
    plain = rows.select("label", F.lit(0).cast("long").alias("least"), "place", "t", F.lit(None).cast("array<string>").alias("heads"))
    tallied = plain.mapInArrow(lambda batches: _tallied(batches, shortest, False), _COUNTED)
    heads = tallied.groupBy("label", "span").agg(F.sum("n").alias("n"), F.min("place").alias("place")).where("n >= 2")
    per = Window.partitionBy("label")
    top = staged(heads.withColumn("r", F.row_number().over(per.orderBy(F.desc("n"), "place"))).where(F.col("r") <= keep))
    every = top.select("label", "span", "n", "place")
    if longest > shortest:
        rarest = top.groupBy("label").agg(F.coalesce(F.max(F.when(F.col("r") == keep, F.col("n"))), F.lit(1)).alias("least"), F.collect_list(F.struct("n", "span")).alias("_h"))
        open_ = rarest.select("label", "least", F.transform(F.filter("_h", lambda x: x["n"] > F.col("least")), lambda x: x["span"]).alias("heads")).where(F.size("heads") > 0)
        longer = rows.join(open_, "label").select("label", "least", "place", "t", "heads").mapInArrow(lambda batches: _tallied(batches, longest, True), _COUNTED)
        sorted_ = longer.withColumn("_h", F.substring("span", 1, shortest)).repartition("label", "_h").sortWithinPartitions("label", "span").drop("_h")
        every = every.unionByName(sorted_.mapInArrow(lambda batches: _prefixes(batches, shortest), "label long, span string, n long, place long"))
    r = F.row_number().over(per.orderBy(F.desc("n"), F.length("span"), "place"))
    return every.withColumn("r", r).where(F.col("r") <= keep).select(F.col("label").cast(texts.schema["label"].dataType).alias("label"), "span", "n", "r")


def _lowered(texts: DataFrame) -> DataFrame:
    return staged(texts.select("label", "idx", F.lower("text").alias("t")))


def candidate_spans(texts: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, keep: int = 50) -> DataFrame:
    """label, span, n, r: the commonest substrings of each cluster's (label, idx, text); at least twice; ties by length, text, position.

    A substring is no commoner than the shortest one that it begins with, and comes after that where they are equally common. So if keep of the
    shortest ones occur least times or more, a longer one is among the first keep only if it occurs more than least times, and its beginning does:
    the shortest ones are counted, and only the fewer than keep of each cluster that occur more often than least are extended.
    """
    return _candidate_spans(_lowered(texts), shortest, longest, keep)


def _holding(batches: Iterator[pa.RecordBatch], spans: list[str], shortest: int) -> Iterator[pa.RecordBatch]:
    """span, n: how many of the texts hold each span."""
    begun: dict[str, list[str]] = {}
    for span in spans:
        begun.setdefault(span[:shortest], []).append(span)
    n: Counter[str] = Counter()
    for (text,) in _each(batches, "t"):
        found = set()
        for i in range(len(text) - shortest + 1):
            if (known := begun.get(text[i : i + shortest])) is not None:
                found.update(span for span in known if text.startswith(span, i))
        n.update(found)
    yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["span", "n"])


def texts_with(texts: DataFrame, spans: DataFrame, shortest: int) -> DataFrame:
    """span, n: of a staged table of distinct spans those that texts (text) hold, and how many. The texts are read once for each SPANS spans."""
    low = texts.select(F.lower("text").alias("t")).where(F.length("t") >= shortest)
    parts = max(1, -(-spans.count() // SPANS))
    out = None
    for k in range(parts):
        some = [r.span for r in spans.where(F.pmod(F.xxhash64("span"), F.lit(parts)) == k).collect()]
        part = low.mapInArrow(lambda batches, some=some: _holding(batches, some, shortest), "span string, n long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("span").agg(F.sum("n").alias("n"))


def regex_patterns(labelled: DataFrame, min_precision: float = 0.99, max_patterns: int = 20, shortest: int = 8, benign: DataFrame | None = None) -> DataFrame:
    """label, r, span, recall[, benign_rate]: of the first max_patterns candidates those that enough positives hold; clusters of 4 positives or more.

    With a benign table (text), the share of benign texts that hold the span: what a precision would rest on.
    """
    pos = _lowered(positives(labelled))
    sizes = pos.groupBy("label").agg(F.count("*").alias("_n")).where("_n >= 4")
    pos = pos.join(sizes.select("label"), "label", "left_semi")
    spans = staged(_candidate_spans(pos, shortest, max(LONGEST, shortest), max_patterns))
    lists = spans.groupBy("label").agg(F.collect_list(F.struct("r", "span")).alias("_s"))
    met = pos.join(lists, "label").select("label", F.explode(F.filter("_s", lambda x: F.contains(F.col("t"), x["span"]))).alias("_x"))
    hits = met.groupBy("label", F.col("_x.r").alias("r")).agg(F.count("*").alias("_c"))
    held = spans.join(hits, ["label", "r"]).join(sizes, "label").select("label", "r", "span", (F.col("_c") / F.col("_n")).alias("recall")).where(F.col("recall") >= min_precision)
    if benign is None:
        return held
    held = staged(held)
    met = texts_with(benign, staged(held.select("span").distinct()), shortest).withColumnRenamed("n", "_b")
    many = F.broadcast(benign.agg(F.count("*").alias("_m")))  # one row
    rate = F.when(F.col("_m") > 0, F.coalesce("_b", F.lit(0)) / F.col("_m"))
    return held.join(met, "span", "left").join(many).select("label", "r", "span", "recall", rate.alias("benign_rate"))


def policy_rules(labelled: DataFrame, dsl: str = "cedar") -> DataFrame:
    """label, rule: a rule on the beginning of each cluster's first input."""
    if dsl not in ("cedar", "rego"):
        raise ValueError(f"unknown rule language: {dsl}")
    sample = F.replace(F.substring(F.min_by("input", "idx"), 1, 80), F.lit('"'), F.lit('\\"'))
    first = labelled.groupBy("label").agg(sample.alias("s"))
    if dsl == "cedar":
        rule = F.concat(F.lit('forbid (principal, action == Action::"submitPrompt", resource) when { context.prompt like "*'), "s", F.lit('*" };'))
    else:
        rule = F.concat(F.lit("package guard.cluster_"), F.col("label").cast("string"), F.lit('\ndeny { contains(input.prompt, "'), "s", F.lit('") }'))
    return first.select("label", rule.alias("rule"))


def deliberative_cases(labelled: DataFrame, k: int = 8, policy: str = "") -> DataFrame:
    """label, n_cases, rendered: the first violations of each cluster as cases for a model that deliberates."""
    bad = labelled.where("was_violation").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("idx"))).where(F.col("r") <= k)
    case = F.concat(F.lit("## Case "), F.col("r").cast("string"), F.lit("\nInput: "), F.col("input"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", case.alias("c")))), lambda x: x["c"]), "\n\n")
    return bad.groupBy("label").agg(F.count("*").alias("n_cases"), body.alias("b")).select("label", "n_cases", F.concat(F.lit("# Cases of cluster "), F.col("label").cast("string"), F.lit("\n\n"), "b", F.lit("\n\n---\n" + policy if policy else "")).alias("rendered"))


def steering_vector(rows: DataFrame, features: str, positive: Column, conditional: bool = True, least: int = 8) -> DataFrame:
    """dim, value: mean of the negatives less mean of the positives, by dimension; of unit length if conditional. Fewer positives than least: no rows."""
    each = rows.select(positive.alias("pos"), F.posexplode(F.col(features).cast("array<double>")).alias("dim", "x"))
    v = each.groupBy("dim").agg((F.avg(F.when(~F.col("pos"), F.col("x"))) - F.avg(F.when(F.col("pos"), F.col("x")))).alias("value"), F.count_if("pos").alias("n")).where(F.col("n") >= least)
    if not conditional:
        return v.select("dim", "value")
    norm = v.agg(F.greatest(F.sqrt(F.sum(F.col("value") * F.col("value"))), F.lit(1e-8)).alias("norm"))
    return v.crossJoin(norm).select("dim", (F.col("value") / F.col("norm")).alias("value"))


def distilled_classifier(train: DataFrame, text: str, label: str, features: int = 1 << 14, least: int = 8):
    """An MLlib pipeline (hashed terms, logistic regression), or None for fewer positives than least. Negatives are real rows of the table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    if train.where(F.col(label) == 1).count() < least:
        return None
    stages = [RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+"), HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_idf"), LogisticRegression(featuresCol="_idf", labelCol=label, regParam=0.01)]
    return Pipeline(stages=stages).fit(train)


def compile_guards(labelled: DataFrame, targets: dict, min_asr: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(artifacts, rejected clusters). targets: kind -> function of the kept rows giving (label, payload); one that raises gives a row without payload."""
    groups = clusters(labelled)
    kept = labelled.join(groups.where(F.col("asr") >= min_asr).select("label"), "label")
    notes = groups.join(phrases(labelled), "label")
    out = None
    for kind, fn in targets.items():
        try:
            made = fn(kept).select("label", F.col("payload").cast("string").alias("payload"), F.concat(F.lit(f"{kind}-"), F.col("label").cast("string")).alias("name"))
        except Exception as e:
            made = kept.select("label").distinct().select("label", F.lit(None).cast("string").alias("payload"), F.concat(F.lit("failed-"), F.col("label").cast("string")).alias("name"))
            kind = f"{kind}:{type(e).__name__}"
        rows = made.join(notes, "label").select(F.lit(kind).alias("kind"), "name", "payload", "label", "asr", "n", "summary")
        out = rows if out is None else out.unionByName(rows)
    return out, groups.where(F.col("asr") < min_asr)


def report(artifacts: DataFrame) -> DataFrame:
    line = F.format_string("%s %s: %d records, attack success %.2f%%", "kind", "name", "n", F.col("asr") * 100)
    return artifacts.select("name", line.alias("line"))
