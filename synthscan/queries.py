"""The driver's queries over the test tables, and the same queries as SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detectors.generating import DivergentNGrams, ReviseDetect
from .functions import mage, overlap, perturb
from .functions import text as X
from .operators import evaluate as E
from .operators import statistics as S
from .plans.tables import spread
from .providers.ngram import NGramModel
from .sources.readers import head, scorable, with_row_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    docs = scorable(_table(spark, d, "documents"))
    return docs.select(F.col("doc_id").alias("row_id"), "text")


WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
#: Words, prefix and remainder of each document.
CUT = f"""
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM documents WHERE regexp_matches(text, '{NOT_WS}')),
cut AS (SELECT doc_id, text, CASE WHEN len(w) < 2 THEN text ELSE array_to_string(w[1:c], ' ') END AS prefix, CASE WHEN len(w) < 2 THEN '' ELSE array_to_string(w[c + 1:], ' ') END AS remainder
        FROM (SELECT *, greatest(1, least(floor(0.5 * len(w))::INT, len(w) - 1)) AS c FROM w))"""


@query(f"SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '{NOT_WS}')")
def filter_nonblank(spark: SparkSession, d: str) -> DataFrame:
    return scorable(_table(spark, d, "documents")).select("doc_id", "n_chars")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def debug_head(spark: SparkSession, d: str) -> DataFrame:
    return head(_table(spark, d, "documents"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, CASE WHEN quality IS NOT DISTINCT FROM 0 THEN 1 ELSE 0 END AS machine FROM documents LEFT JOIN labels USING (doc_id)")
def class_split(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id", "left")
    return docs.select("doc_id", E.is_machine(F.col("quality"), 0).alias("machine"))


@query(f"WITH {CUT} SELECT doc_id, prefix, remainder FROM cut")
def truncate_words(spark: SparkSession, d: str) -> DataFrame:
    return spread(_texts(spark, d)).select(F.col("row_id").alias("doc_id"), X.truncated(F.col("text"), 0.5).alias("x")).select("doc_id", "x.prefix", "x.remainder")


@query("""SELECT a.conv_id, a.turn, CASE WHEN coalesce(u.text, '') <> '' THEN u.text || chr(10) || a.text ELSE a.text END AS prompted
FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant'""")
def prompt_prepend(spark: SparkSession, d: str) -> DataFrame:
    turns = _table(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    answers = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"], "left")
    return answers.select("conv_id", "turn", X.with_prompt(F.col("prompt"), F.col("text")).alias("prompted"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS tokens FROM documents")
def dna_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.concat_ws(" ", overlap.tokens(F.col("text"))).alias("tokens"))


def _continued(spark: SparkSession, d: str) -> DataFrame:
    """Each document's remainder, and the next three documents' texts of its language as stand-in continuations."""
    docs = _texts(spark, d).withColumnRenamed("row_id", "doc_id").join(_table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    own = docs.select("doc_id", X.truncated(F.col("text"), 0.5)["remainder"].alias("rest"))
    numbered = with_row_id(docs.select("lang", "doc_id").orderBy("lang", "doc_id"), "place")  # neighbours of a language are numbered in a row
    asked = numbered.select("lang", "doc_id", F.explode(F.array(*(F.col("place") + i for i in (1, 2, 3)))).alias("place"))
    pairs = asked.join(numbered.select("lang", "place", F.col("doc_id").alias("other")), ["lang", "place"]).select("doc_id", "other", "place")
    with_text = pairs.join(docs.select(F.col("doc_id").alias("other"), F.col("text").alias("continuation")), "other")
    return with_text.join(own, "doc_id").groupBy("doc_id").agg(F.first("rest").alias("rest"), F.transform(F.array_sort(F.collect_list(F.struct("place", "continuation"))), lambda x: x["continuation"]).alias("continuations"))


@query(f"""WITH RECURSIVE {CUT},
t AS (SELECT c.doc_id, list_filter(regexp_split_to_array(lower(remainder), '[^a-z0-9]+'), lambda x: x <> '') AS rest,
             list_filter(regexp_split_to_array(lower(c.text), '[^a-z0-9]+'), lambda x: x <> '') AS whole,
             row_number() OVER (PARTITION BY lang ORDER BY c.doc_id) AS place, lang FROM cut c JOIN documents d USING (doc_id)),
p AS (SELECT a.doc_id, b.doc_id AS other, len(b.whole) AS size_y FROM t a JOIN t b ON a.lang = b.lang AND b.place BETWEEN a.place + 1 AND a.place + 3),
tw AS (SELECT 0 AS kind, doc_id, generate_subscripts(rest, 1) AS i, unnest(rest) AS tok FROM t UNION ALL SELECT 1, doc_id, generate_subscripts(whole, 1), unnest(whole) FROM t),
e AS (SELECT kind, doc_id, i, 1 AS n, hash(tok) AS h FROM tw UNION ALL
      SELECT e.kind, e.doc_id, e.i, n + 1, hash(h, tok) FROM e JOIN tw ON tw.kind = e.kind AND tw.doc_id = e.doc_id AND tw.i = e.i + n WHERE n < 25),
g1 AS (SELECT DISTINCT doc_id AS other, n, h FROM e WHERE kind = 1 AND n > 1),
g0 AS (SELECT DISTINCT doc_id, n, h FROM e WHERE kind = 0 AND n > 1),
z AS (SELECT doc_id, n, count(*) AS size FROM g0 GROUP BY doc_id, n),
m AS (SELECT p.doc_id, p.other, size_y, g0.n, count(*) AS shared FROM p JOIN g0 USING (doc_id) JOIN g1 ON g1.other = p.other AND g1.n = g0.n AND g1.h = g0.h GROUP BY ALL),
s AS (SELECT doc_id, sum(n * ln(n) * shared / (size_y * size)) AS s FROM m JOIN z USING (doc_id, n) GROUP BY doc_id)
SELECT p.doc_id, round(coalesce(any_value(s.s), 0) / count(*), 8) AS bscore FROM p LEFT JOIN s USING (doc_id) GROUP BY p.doc_id""")
def ngram_bscore(spark: SparkSession, d: str) -> DataFrame:
    """n-gram overlap for n up to 25, on Arrow batches. The SQL makes n-grams' hashes by one word more at a time."""
    rows = _continued(spark, d)
    return rows.select("doc_id", F.round(overlap.bscore_of_texts()("rest", "continuations"), 8).alias("bscore"))


@query()
def dna_gpt_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The detector with stop words and stems, its continuations taken from the next documents through the cache."""
    from .plans.tables import stored

    texts = stored(_texts(spark, d), "texts")
    detector = DivergentNGrams(generate=_rotations, cache_dir=_scratch(spark))
    return detector.score(texts).select("row_id", F.round("score", 8).alias("score"))


def _rotations(prefixes: list[str], k: int = 20) -> list[list[str]]:
    """A stand-in generator: the prefix's words, turned by another part of them each time; the same on every run."""
    out = []
    for p in prefixes:
        w = (p or "").split()
        at = [i * len(w) // k for i in range(k)]
        out.append([" ".join(w[i:] + w[:i]) for i in at])
    return out


def _reversed(texts: list[str]) -> list[str]:
    """A stand-in reviser: the sentences in reverse order."""
    return [". ".join(reversed((t or "").split(". "))) for t in texts]


def _scratch(spark: SparkSession) -> str:
    from .plans.tables import shared_dir

    return f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"


@query(f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t,
  list_filter(regexp_split_to_array(lower(CASE WHEN regexp_matches(r, '{NOT_WS}') THEN regexp_replace(r, '^{WS}+|{WS}+$', '', 'g') ELSE text END), '[^a-z0-9]+'), lambda x: x <> '') AS s
  FROM (SELECT *, array_to_string(list_reverse(string_split(text, '. ')), '. ') AS r FROM documents WHERE regexp_matches(text, '{NOT_WS}'))),
w AS (SELECT tok, count(*) AS c FROM (SELECT unnest(t) AS tok FROM t) GROUP BY tok),
n AS (SELECT sum(c) + 0.1::DOUBLE * count(*) AS n FROM w),
a AS (SELECT doc_id, tok, count(*) AS n FROM (SELECT doc_id, unnest(t) AS tok FROM t) GROUP BY ALL),
b AS (SELECT doc_id, tok, count(*) AS own FROM (SELECT doc_id, unnest(s) AS tok FROM t) GROUP BY ALL),
x AS (SELECT a.doc_id, sum(a.n * ln(0.5 * (c + 0.1::DOUBLE) / (SELECT n FROM n) + 0.5 * coalesce(own / len(t.s), 0))) / sum(a.n) AS score FROM a JOIN t USING (doc_id) LEFT JOIN b USING (doc_id, tok) JOIN w USING (tok) GROUP BY a.doc_id)
SELECT t.doc_id AS row_id, round(x.score, 6) AS score FROM t LEFT JOIN x USING (doc_id)""")
def revise_detect(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return ReviseDetect(generate=_reversed, cache_dir=_scratch(spark)).score(texts).select("row_id", F.round("score", 6).alias("score"))


@query(f"""WITH {CUT} SELECT doc_id, sha256(prefix || chr(0) || '0.5' || chr(0) || '20') AS continuation_key, sha256(text) AS revision_key FROM cut""")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select(F.col("row_id").alias("doc_id"), X.continuation_key(X.truncated(F.col("text"), 0.5)["prefix"], 0.5, 20).alias("continuation_key"), X.revision_key(F.col("text")).alias("revision_key"))


def _revised(spark: SparkSession, docs: DataFrame):
    """A cache with the texts of docs behind a mark as revisions, and the cache's own way of adding them."""
    from .sources.cache import revisions

    store = revisions(spark, _scratch(spark), "some/model: one")
    store.added(docs.select(X.revision_key(F.col("text")).alias("hash"), F.concat(F.lit("> "), "text").alias("revised")))
    return store


@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE lang <> 'en' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def cache_miss_anti_join(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    asked = docs.where("lang <> 'en'").select(X.revision_key(F.col("text")).alias("hash"))
    return _revised(spark, docs.where("lang = 'en'")).misses(asked, "hash")


@query("SELECT DISTINCT sha256(text) AS hash, CASE WHEN lang = 'en' THEN '> ' || text ELSE text END AS revised FROM documents WHERE text NOT IN (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT lang = 'en') > 1)")
def cache_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """What is there stays: keys of the English texts keep their first value, the others get the one added later."""
    docs = _table(spark, d, "documents")
    store = _revised(spark, docs.where("lang = 'en'"))
    store.added(docs.select(X.revision_key(F.col("text")).alias("hash"), F.col("text").alias("revised")))
    mixed = docs.groupBy("text").agg(F.count_distinct(F.col("lang") == "en").alias("n")).where("n > 1").select(X.revision_key(F.col("text")).alias("hash"))
    return store.table().join(mixed, "hash", "left_anti")


@query("SELECT doc_id, CASE WHEN lang = 'en' OR text IN (SELECT text FROM documents WHERE lang = 'en') THEN '> ' || text END AS revised FROM documents")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    keyed = docs.select("doc_id", X.revision_key(F.col("text")).alias("hash"))
    return _revised(spark, docs.where("lang = 'en'")).looked_up(keyed, "hash").select("doc_id", "revised")


@query("""SELECT count(DISTINCT text) AS n_keys, count(DISTINCT CASE WHEN e THEN text END) AS n_hits, count(DISTINCT CASE WHEN NOT e THEN text END) AS n_misses,
count(DISTINCT CASE WHEN e THEN text END) AS n_cached FROM (SELECT text, text IN (SELECT text FROM documents WHERE lang = 'en') AS e FROM documents)""")
def cache_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return _revised(spark, docs.where("lang = 'en'")).statistics(docs.select(X.revision_key(F.col("text")).alias("hash")), "hash")


@query("""WITH p AS (SELECT DISTINCT source, list_transform(range(0, 3 + length(source) % 3), lambda i: source || '#' || i) AS c FROM documents WHERE source IS NOT NULL)
SELECT sha256(source) AS hash, CASE WHEN len(c) >= 4 THEN array_to_string(c[1:4], ' ') END AS continuations FROM p""")
def continuation_cache(spark: SparkSession, d: str) -> DataFrame:
    """Entries with fewer continuations than asked for are misses, others are cut to the first ones."""
    from .sources.cache import continuations

    store = continuations(spark, _scratch(spark), "m")
    names = _table(spark, d, "documents").where("source IS NOT NULL").select("source").distinct()
    own = F.transform(F.sequence(F.lit(0), F.lit(2) + F.length("source") % 3), lambda i: F.concat("source", F.lit("#"), i.cast("string")))
    store.added(names.select(X.revision_key(F.col("source")).alias("hash"), F.slice(own, 1, 2).alias("continuations")))
    store.added(names.select(X.revision_key(F.col("source")).alias("hash"), own.alias("continuations")), 3)
    return store.looked_up(names.select(X.revision_key(F.col("source")).alias("hash")), "hash", 4).select("hash", F.array_join("continuations", " ").alias("continuations"))


@query(r"SELECT DISTINCT regexp_replace(source, '[^A-Za-z0-9._-]+', '_', 'g') AS shard FROM documents")
def shard_names(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(X.shard_name(F.col("source")).alias("shard")).distinct()


@query(r"""SELECT doc_id, replace(regexp_replace(regexp_replace(replace(text, chr(10), '\n'), '(?:\\n)+', '\\n', 'g'), '^[^\n]{0,3}\\n', ''), '\n', ' ') AS text FROM documents""")
def mage_line_breaks(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", mage.without_line_breaks(F.col("text")).alias("text"))


@query(r"SELECT page_id, regexp_replace(html, '<pad>|<s>|</s>|<unk>|<\|endoftext\|>', '', 'g') AS html FROM pages")
def mage_special_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", mage.without_special_tokens(F.col("html")).alias("html"))


@query(f"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, {"'" + mage.FORBIDDEN.replace("'", "''") + "'"}, '', 'g'), {"'" + mage.RUNS.replace("'", "''") + "'"}, '', 'g'), ' +', ' ', 'g'), '^ | $', '', 'g') AS html FROM pages""")
def mage_whitelist(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", mage.allowed(F.col("html")).alias("html"))


@query()
def mage_full(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", mage.normalised(F.col("text")).alias("text"))


def _punctuation_sql(lang: str, penn: bool) -> str:
    """The rules as nested calls."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    text = "text"
    for pattern, new in mage.moses_rules(lang, penn):
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(new.replace('$', chr(92)))}, 'g')"
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


@query(f"SELECT doc_id, CASE {' '.join(f"WHEN lang = '{x}' THEN {_punctuation_sql(x, False)}" for x in ('de', 'es', 'fr'))} ELSE {_punctuation_sql('en', True)} END AS text FROM documents")
def mage_punctuation_by_language(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    each = F.coalesce(*(F.when(F.col("lang") == x, mage.punctuation(text, x, penn=False)) for x in ("de", "es", "fr")), mage.punctuation(text))
    return spread(_table(spark, d, "documents").select("doc_id", "lang", "text")).select("doc_id", each.alias("text"))


#: The n-gram model's tables for DuckDB: pairs of each document's tokens, counts, ranks and context sums.
LM = f"""
t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents WHERE regexp_matches(text, '{NOT_WS}')),
pr AS (SELECT doc_id, x.a AS ctx, x.b AS tok, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS x FROM t WHERE len(t) > 1) GROUP BY ALL),
v AS (SELECT count(DISTINCT x) AS V FROM (SELECT unnest(t) AS x FROM t)),
bg AS (SELECT ctx, tok, sum(n) AS c, sum(sum(n)) OVER (PARTITION BY ctx) AS m, rank() OVER (PARTITION BY ctx ORDER BY sum(n) DESC) AS rank FROM pr GROUP BY ctx, tok),
cs AS (SELECT ctx, any_value(m) AS m, count(*) AS seen, any_value(V) AS V, sum(p * ln(p)) AS s1, sum(p * ln(p) * ln(p)) AS s2, sum(p * ln(r)) AS sx
       FROM (SELECT bg.*, V, (c + 0.1::DOUBLE) / (m + 0.1::DOUBLE * V) AS p, (c + 0.5::DOUBLE) / (m + 0.5::DOUBLE * V) AS r FROM bg, v) GROUP BY ctx),
cx AS (SELECT ctx, m, V, s1 + (V - seen) * p0 * ln(p0) AS mu, s2 + (V - seen) * p0 * ln(p0) * ln(p0) AS e2, -(sx + (V - seen) * p0 * ln(r0)) AS xent
       FROM (SELECT *, 0.1::DOUBLE / (m + 0.1::DOUBLE * V) AS p0, 0.5::DOUBLE / (m + 0.5::DOUBLE * V) AS r0 FROM cs)),
sc AS (SELECT pr.doc_id, pr.n, bg.rank, ln((c + 0.1::DOUBLE) / (cx.m + 0.1::DOUBLE * V)) AS lp, ln((c + 0.5::DOUBLE) / (cx.m + 0.5::DOUBLE * V)) AS lq, mu, greatest(e2 - mu * mu, 0) AS var
       FROM pr JOIN bg USING (ctx, tok) JOIN cx USING (ctx))"""


@query(f"WITH {LM} SELECT ctx, tok, c::BIGINT AS c, rank::BIGINT AS rank FROM bg")
def token_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of tokens after their contexts, in the model of the documents."""
    return NGramModel(_texts(spark, d)).ranks()


@query(f"""WITH {LM} SELECT t.doc_id AS row_id, round(sum(n * rank) / sum(n), 5) AS mean_rank, round(sum(n * ln(rank)) / sum(n), 6) AS log_rank,
round(CASE WHEN sum(n * ln(rank)) <> 0 THEN sum(n * lp) / sum(n * ln(rank)) END, 6) AS lrr, round((sum(n * lp) - sum(n * mu)) / sqrt(sum(n * var)), 5) AS fast_detect_gpt
FROM t LEFT JOIN sc USING (doc_id) GROUP BY t.doc_id""")
def zero_shot_scores(spark: SparkSession, d: str) -> DataFrame:
    """rank, log-rank, lrr and fast-detect-gpt in one pass over shared token scores."""
    from .detectors.zero_shot import all_zero_shot

    texts = _texts(spark, d)
    found = texts.select("row_id").join(all_zero_shot(texts), "row_id", "left")
    return found.select("row_id", F.round("rank", 5).alias("mean_rank"), F.round("log-rank", 6).alias("log_rank"), F.round("lrr", 6).alias("lrr"), F.round("fast-detect-gpt", 5).alias("fast_detect_gpt"))


@query(f"""WITH {LM} SELECT t.doc_id AS row_id, round(sum(n * rank) / sum(n), 5) AS mean_rank, round(sum(n * ln(rank)) / sum(n), 6) AS log_rank,
round(CASE WHEN sum(n * ln(rank)) <> 0 THEN sum(n * lp) / sum(n * ln(rank)) END, 6) AS lrr, round((sum(n * lp) - sum(n * mu)) / sqrt(sum(n * var)), 5) AS fast_detect_gpt
FROM t LEFT JOIN sc USING (doc_id) GROUP BY t.doc_id""")
def packed_scores(spark: SparkSession, d: str) -> DataFrame:
    """The same of packed scores: a row a text, statistics as array expressions in the row."""
    texts = _texts(spark, d)
    found = NGramModel(texts).chunks.texts("logprob", "rank", "mean_lp", "var_lp")
    return found.select("row_id", F.round(S.packed("rank"), 5).alias("mean_rank"), *(F.round(S.packed(x), n).alias(x.replace("-", "_")) for x, n in (("log-rank", 6), ("lrr", 6), ("fast-detect-gpt", 5))))


@query(f"""WITH {LM},
u AS (SELECT doc_id, t FROM t),
up AS (SELECT doc_id, x.a AS ctx, x.b AS tok FROM (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS x FROM u WHERE len(t) > 1)),
pp AS (SELECT doc_id, avg(-ln((c + 0.5::DOUBLE) / (cx.m + 0.5::DOUBLE * V))) AS p FROM up JOIN bg USING (ctx, tok) JOIN cx USING (ctx) GROUP BY doc_id),
xx AS (SELECT doc_id, avg(coalesce(xent, ln((SELECT V FROM v)))) AS x FROM (SELECT doc_id, unnest(t) AS ctx FROM u) LEFT JOIN cx USING (ctx) GROUP BY doc_id),
o AS (SELECT t.doc_id, sum(n * rank) / sum(n) AS r, sum(n * ln(rank)) / sum(n) AS l FROM t LEFT JOIN sc USING (doc_id) GROUP BY t.doc_id)
SELECT o.doc_id AS row_id, round(r, 5) AS rank, round(l, 6) AS log_rank, round(-p / x, 6) AS binoculars FROM o LEFT JOIN pp USING (doc_id) LEFT JOIN xx USING (doc_id)""")
def shared_run(spark: SparkSession, d: str) -> DataFrame:
    """A run of three detectors over one counted model: what they share is computed once, written as versions and joined once."""
    from .plans.scoring import scored

    texts = _texts(spark, d)
    found = scored(spark, texts, f"{_scratch(spark)}/shared_scores", ["rank", "log-rank", "binoculars"])
    return found.select("row_id", F.round("rank", 5).alias("rank"), F.round("log-rank", 6).alias("log_rank"), F.round("binoculars", 6).alias("binoculars"))


@query("SELECT d.doc_id, 2 * n_chars::DOUBLE AS first, quality::DOUBLE AS second FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def score_versions(spark: SparkSession, d: str) -> DataFrame:
    """Scores that were forced anew: the last version counts, older ones stay until they expire."""
    from .sources import sinks

    path = f"{_scratch(spark)}/versions"
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text", "n_chars")
    hashes = docs.select("row_id", F.sha2("text", 256).alias("text_hash"), F.col("n_chars").cast("double").alias("score"))
    sinks.write_scores(hashes, path, "first")
    labels = _table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("double").alias("second"))
    sinks.write_scores(hashes.drop("score").join(labels, "row_id"), path, "second")
    sinks.write_scores(hashes.withColumn("score", F.col("score") * 2), path, "first")
    sinks.expire(spark, path, 1)
    return sinks.attach(docs, spark, path, ["first", "second"], "row_id", "text").select(F.col("row_id").alias("doc_id"), "first", "second")


def _one_detector(name: str, oracle: str):
    @query(f"WITH {LM} SELECT t.doc_id AS row_id, {oracle} AS score FROM t LEFT JOIN sc USING (doc_id) GROUP BY t.doc_id")
    def run(spark: SparkSession, d: str) -> DataFrame:
        from .detectors import get_detector

        return get_detector(name)().score(_texts(spark, d)).select("row_id", F.round("score", 5).alias("score"))

    key = f"detector_{name.replace('-', '_')}"
    QUERIES[key], ORACLES[key] = QUERIES.pop("run"), ORACLES.pop("run")


_one_detector("rank", "round(sum(n * rank) / sum(n), 5)")
_one_detector("log-rank", "round(sum(n * ln(rank)) / sum(n), 5)")
_one_detector("lrr", "round(CASE WHEN sum(n * ln(rank)) <> 0 THEN sum(n * lp) / sum(n * ln(rank)) END, 5)")
_one_detector("fast-detect-gpt", "round((sum(n * lp) - sum(n * mu)) / sqrt(sum(n * var)), 5)")


@query(f"""WITH {LM},
u AS (SELECT doc_id, t FROM t),
up AS (SELECT doc_id, x.a AS ctx, x.b AS tok FROM (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS x FROM u WHERE len(t) > 1)),
pp AS (SELECT doc_id, avg(-ln((c + 0.5::DOUBLE) / (cx.m + 0.5::DOUBLE * V))) AS p FROM up JOIN bg USING (ctx, tok) JOIN cx USING (ctx) GROUP BY doc_id),
xx AS (SELECT doc_id, avg(coalesce(xent, ln((SELECT V FROM v)))) AS x FROM (SELECT doc_id, unnest(t) AS ctx FROM u) LEFT JOIN cx USING (ctx) GROUP BY doc_id)
SELECT t.doc_id AS row_id, round(-p / x, 6) AS score FROM t LEFT JOIN pp USING (doc_id) LEFT JOIN xx USING (doc_id)""")
def detector_binoculars(spark: SparkSession, d: str) -> DataFrame:
    from .detectors import get_detector

    return get_detector("binoculars")().score(_texts(spark, d)).select("row_id", F.round("score", 6).alias("score"))


@query(f"""WITH {LM},
up AS (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS x FROM t WHERE len(t) > 1),
pp AS (SELECT doc_id, median(-ln((c + 0.5::DOUBLE) / (cx.m + 0.5::DOUBLE * V))) AS p FROM (SELECT doc_id, x.a AS ctx, x.b AS tok FROM up) JOIN bg USING (ctx, tok) JOIN cx USING (ctx) GROUP BY doc_id),
xx AS (SELECT doc_id, median(coalesce(xent, ln((SELECT V FROM v)))) AS x FROM (SELECT doc_id, unnest(t) AS ctx FROM t) LEFT JOIN cx USING (ctx) GROUP BY doc_id)
SELECT t.doc_id AS row_id, round(-p / x, 6) AS score FROM t LEFT JOIN pp USING (doc_id) LEFT JOIN xx USING (doc_id)""")
def binoculars_median(spark: SparkSession, d: str) -> DataFrame:
    """The same with medians of the positions."""
    from .detectors import get_detector

    return get_detector("binoculars")(median=True).score(_texts(spark, d)).select("row_id", F.round("score", 6).alias("score"))


@query()
def binoculars_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Cross-entropy from one drawn token for each place, at a temperature."""
    from .detectors import get_detector

    return get_detector("binoculars")(sample=True, temperature=0.8, seed=3).score(_texts(spark, d)).select("row_id", F.round("score", 6).alias("score"))


@query()
def detector_npr(spark: SparkSession, d: str) -> DataFrame:
    """Ten seeded perturbations a document, filled without a model."""
    from .detectors import get_detector

    return get_detector("npr")(fill=perturb.repeat_fill, seed=1).score(_texts(spark, d)).select("row_id", F.round("score", 6).alias("score"))


@query()
def perturbations(spark: SparkSession, d: str) -> DataFrame:
    return perturb.perturbed(_texts(spark, d), "row_id", "text", 2, perturb.repeat_fill, seed=1)


@query("""SELECT vec_id, round(exp(e[1] - list_max(e)) / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 10) AS probability, e[1] AS logit
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def supervised_scores(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings stand in for logits."""
    logits = F.col("embedding").cast("array<double>")
    return _table(spark, d, "embeddings").select("vec_id", F.round(S.class_probability(logits), 10).alias("probability"), S.class_logit(logits).alias("logit"))


@query("SELECT l_orderkey AS row_id, round(sum(ln(l_quantity / 51)) / count(*), 8) AS score FROM lineitem GROUP BY l_orderkey")
def bartscore_agg(spark: SparkSession, d: str) -> DataFrame:
    """Line quantities stand in for token probabilities."""
    rows = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.ln(F.col("l_quantity") / 51).alias("logprob"))
    return S.sequence_score(rows).select("row_id", F.round("revise-detect", 8).alias("score"))


#: Scores with long ties for evaluation: line quantities, labelled by return flag; the ship mode's status as dataset.
TIED = "SELECT l_linestatus AS dataset, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity::DOUBLE AS s FROM lineitem"
CURVE = f"""
g AS (SELECT dataset AS d, s, sum(y) AS p, sum(1 - y) AS n FROM ({TIED}) GROUP BY ALL),
c AS (SELECT d, s, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (PARTITION BY d ORDER BY s DESC)),
l AS (SELECT *, lead(p) OVER w AS np, lead(n) OVER w AS nn, row_number() OVER w AS i, max(tp) OVER (PARTITION BY d) AS P_, max(fp) OVER (PARTITION BY d) AS N_ FROM c WINDOW w AS (PARTITION BY d ORDER BY s DESC)),
k AS (SELECT d, (fp / N_)::DOUBLE AS f, (tp / P_)::DOUBLE AS t FROM l WHERE i = 1 OR np IS NULL OR np <> p OR nn <> n UNION ALL SELECT DISTINCT d, 0::DOUBLE, 0::DOUBLE FROM l),
e AS (SELECT *, row_number() OVER w AS i, lag(f) OVER w AS f0, lag(t) OVER w AS t0 FROM k WINDOW w AS (PARTITION BY d ORDER BY f, t)),
a AS (SELECT d, m, sum(CASE WHEN f0 IS NULL OR f0 >= m OR f = f0 THEN 0 WHEN f <= m THEN (f - f0) * (t + t0) / 2 ELSE (m - f0) * (t0 + t0 + (t - t0) * (m - f0) / (f - f0)) / 2 END) AS area
      FROM e, (SELECT unnest([0.001::DOUBLE, 0.01::DOUBLE, 0.1::DOUBLE, 1.0::DOUBLE]) AS m) GROUP BY d, m),
x AS (SELECT d, m, arg_min(CASE WHEN t0 IS NULL THEN t ELSE (t + t0) / 2 END, i) AS tpr FROM e, (SELECT unnest([0.001::DOUBLE, 0.01::DOUBLE, 0.1::DOUBLE]) AS m) WHERE f >= m GROUP BY d, m),
r AS (SELECT a.d AS dataset, 'quantity' AS detector, max(area) FILTER (m = 1) AS roc_auc,
  {", ".join(f"max(0.5 * (1 + (area - m * m / 2) / (m - m * m / 2))) FILTER (m = {q}::DOUBLE) AS a{i}" for i, q in enumerate((0.001, 0.01, 0.1)))} FROM a GROUP BY a.d),
z AS (SELECT d, {", ".join(f"max(100 * tpr) FILTER (m = {q}::DOUBLE) AS t{i}" for i, q in enumerate((0.001, 0.01, 0.1)))} FROM x GROUP BY d)"""


def _tied(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "lineitem").select(F.col("l_linestatus").alias("set"), (F.col("l_returnflag") == "R").cast("int").alias("flag"), F.col("l_quantity").alias("quantity"))
    return E.long_scores(rows, ["quantity"], E.is_machine(F.col("flag")), F.col("set"))


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    named = {c: c.replace(".", "_") for c in df.columns}
    return df.select(*(F.round(F.col(f"`{c}`"), digits).alias(n) if dict(df.dtypes)[c] == "double" else F.col(f"`{c}`").alias(n) for c, n in named.items()))


@query(f"WITH {CURVE} SELECT d AS dataset, 'quantity' AS detector, round(f, 10) AS fpr, round(t, 10) AS tpr FROM k")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.roc_points(_tied(spark, d)), 10)


_NAMES = ", ".join([*(f"round(a{i}, 8) AS auroc_at_{x}" for i, x in enumerate(("0_001", "0_01", "0_1"))), *(f"round(t{i}, 8) AS tpr_at_{x}" for i, x in enumerate(("0_001", "0_01", "0_1")))])


@query(f"WITH {CURVE} SELECT dataset, detector, round(roc_auc, 8) AS roc_auc, {_NAMES} FROM r JOIN z ON r.dataset = z.d")
def roc_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AUC, partial AUC and rates of heavily tied scores."""
    return _rounded(E.metrics(_tied(spark, d)))


@query(f"WITH {CURVE} SELECT detector, {', '.join(f'round(avg({a}), 8) AS {n}' for a, n in [('roc_auc', 'roc_auc'), *((f'a{i}', f'auroc_at_{x}') for i, x in enumerate(('0_001', '0_01', '0_1'))), *((f't{i}', f'tpr_at_{x}') for i, x in enumerate(('0_001', '0_01', '0_1')))])} FROM r JOIN z ON r.dataset = z.d GROUP BY detector")
def macro_average(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.macro_average(E.metrics(_tied(spark, d))))


@query(f"""WITH {LM}, s AS (SELECT doc_id, round(sum(n * ln(rank)) / sum(n), 10) AS s FROM sc GROUP BY doc_id),
y AS (SELECT s, CASE WHEN quality IS NOT DISTINCT FROM 0 THEN 1 ELSE 0 END AS y FROM s JOIN labels USING (doc_id) WHERE s IS NOT NULL),
rk AS (SELECT y, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2)::DOUBLE AS r FROM y)
SELECT 'log-rank' AS detector, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS roc_auc FROM rk""")
def log_rank_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The minimum end-to-end run: documents, n-gram model, log-rank, labels, ROC AUC."""
    return flagship(spark, d).select("detector", F.round("roc_auc", 6).alias("roc_auc"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    from .detectors import get_detector

    labels = _table(spark, d, "labels")
    scores = get_detector("log-rank")().score(_texts(spark, d)).withColumnRenamed("score", "log-rank")
    rows = scores.join(labels.withColumnRenamed("doc_id", "row_id"), "row_id")
    return E.metrics(E.long_scores(rows, ["log-rank"], E.is_machine(F.col("quality"), 0)))


@query("SELECT d.doc_id, quality::DOUBLE AS first, CASE WHEN lang = 'en' THEN quality::DOUBLE END AS second FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0")
def resume_merge(spark: SparkSession, d: str) -> DataFrame:
    """Saved scores meet their rows by id and text; rows without any, or whose text has changed, get null."""
    from .sources import sinks

    path = f"{_scratch(spark)}/documents_scores"
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang")
    saved = docs.join(_table(spark, d, "labels").where("toxic = 0").withColumnRenamed("doc_id", "row_id"), "row_id").select("row_id", "text", "lang", F.col("quality").cast("double").alias("score"))
    sinks.write_scores(saved.select("row_id", F.sha2("text", 256).alias("text_hash"), "score"), path, "first")
    other = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit("!")))
    sinks.write_scores(saved.select("row_id", F.sha2(other, 256).alias("text_hash"), "score"), path, "second")
    out = sinks.attach(docs, spark, path, sinks.scored_detectors(spark, path), "row_id", "text")
    return out.select(F.col("row_id").alias("doc_id"), "first", "second")


def _reread(spark: SparkSession, df: DataFrame, suffix: str) -> DataFrame:
    """Rows written in a format and loaded as a dataset of it."""
    from .sources import readers

    path = f"{_scratch(spark)}/set.{suffix}"
    if suffix == "csv":
        df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    elif suffix == "json":  # an array of objects in one file
        one = df.select(F.to_json(F.struct(*df.columns)).alias("x")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("x")), ",\n"), F.lit("]")))
        one.coalesce(1).write.text(path)
    elif suffix in ("parquet", "orc"):
        df.write.format(suffix).save(path)
    else:
        df.write.json(path)
    return readers.load(spark, path, "text").select(df.columns)


_SMALL = "SELECT item_id, text FROM benchmark"


@query(_SMALL)
def read_csv(spark: SparkSession, d: str) -> DataFrame:
    return _reread(spark, _table(spark, d, "benchmark").select("item_id", "text"), "csv").withColumn("item_id", F.col("item_id").cast("long"))


@query("SELECT doc_id, text FROM documents")
def read_jsonl(spark: SparkSession, d: str) -> DataFrame:
    return _reread(spark, _table(spark, d, "documents").select("doc_id", "text"), "jsonl")


@query(_SMALL)
def read_json_array(spark: SparkSession, d: str) -> DataFrame:
    return _reread(spark, _table(spark, d, "benchmark").select("item_id", "text"), "json")


@query("SELECT doc_id, text FROM documents")
def read_sniffed_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines under a name that doesn't say so."""
    return _reread(spark, _table(spark, d, "documents").select("doc_id", "text"), "data")


@query("SELECT doc_id, text FROM documents")
def read_orc(spark: SparkSession, d: str) -> DataFrame:
    return _reread(spark, _table(spark, d, "documents").select("doc_id", "text"), "orc")


@query("SELECT 'documents' AS dataset, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark")
def read_several(spark: SparkSession, d: str) -> DataFrame:
    """Datasets under one another."""
    from .sources import readers

    both = readers.load_all(spark, [f"{d}/{x}.parquet" for x in ("documents", "benchmark")])
    return both.select(F.element_at(F.split(F.element_at(F.split("dataset", "/"), -1), "[.]"), 1).alias("dataset"), F.coalesce("doc_id", "item_id").alias("id"), "text")


@query("SELECT count(*) AS n, min(i) AS low, max(i) AS high, count(DISTINCT i) AS ids FROM (SELECT row_number() OVER () - 1 AS i FROM lineitem)")
def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers from 0 without gaps."""
    return with_row_id(_table(spark, d, "lineitem").select("l_quantity")).agg(F.count("*").alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.count_distinct("row_id").alias("ids"))


@query("SELECT doc_id, round(n_chars / 7, 10) AS score, CASE WHEN n_chars % 2 = 0 THEN 'x' END AS note FROM documents")
def export_scores(spark: SparkSession, d: str) -> DataFrame:
    """A widened table as JSON lines, read back; nulls are written."""
    from .sources import sinks

    path = f"{_scratch(spark)}/export"
    sinks.export_jsonl(_table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 7).alias("score"), F.when(F.col("n_chars") % 2 == 0, F.lit("x")).alias("note")), path)
    return spark.read.json(path).select("doc_id", "score", "note")


@query("SELECT doc_id, greatest(1, least(2 * n_chars, 1024)) AS budget, greatest(1, least(least(2 * n_chars, 1024), greatest(1, 4096 - n_chars))) AS in_context FROM documents")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Tokens to generate for a revision, from the length of its prompt."""
    return _table(spark, d, "documents").select("doc_id", X.token_budget(F.col("n_chars")).cast("long").alias("budget"), X.token_budget(F.col("n_chars"), context=4096).cast("long").alias("in_context"))


@query(f"SELECT page_id, regexp_replace(html, '^{WS}+|{WS}+$', '', 'g') AS html FROM pages")
def stripped(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", X.strip(F.col("html")).alias("html"))


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 2 = 0 THEN text ELSE 'kept ' || turn END AS source FROM conversations")
def empty_output_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Blank revisions are replaced by the text."""
    revised = F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 0), F.when(F.col("conv_id") % 2 == 0, F.lit(" \n")).otherwise(F.lit(None).cast("string"))).otherwise(F.concat(F.lit(" kept "), F.col("turn"), F.lit("\t")))
    return _table(spark, d, "conversations").select("conv_id", "turn", X.or_original(revised, F.col("text")).alias("source"))


@query(r"SELECT page_id, len(list_filter(regexp_split_to_array(html, '\s+'), lambda x: starts_with(x, '<extra_id_'))) + 1 AS masks FROM pages")
def mask_count(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", perturb.mask_count(F.concat(F.lit("<extra_id_0> "), F.col("html"))).cast("long").alias("masks"))


@query("""SELECT doc_id, ['binoculars', 'dna-gpt', 'fast-detect-gpt', 'log-rank', 'lrr', 'mage', 'npr', 'radar', 'rank', 'remodetect', 'revise-detect'][doc_id % 11 + 1] AS name
FROM labels""")
def detector_names(spark: SparkSession, d: str) -> DataFrame:
    """Each labelled document with the detector of its number, in the registry's order."""
    from .detectors import list_detectors

    names = F.array(*map(F.lit, list_detectors()))
    return _table(spark, d, "labels").select("doc_id", names[(F.col("doc_id") % F.size(names)).cast("int")].alias("name"))


@query("SELECT DISTINCT sha256(text) AS hash, 'Revise the following text: ' || text AS prompt FROM conversations WHERE role = 'user'")
def revision_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a reviser is asked, by key, through the batches that generating back ends get."""
    from .providers.base import generated

    asked = _table(spark, d, "conversations").where("role = 'user'").select(X.revision_key(F.col("text")).alias("hash"), "text").dropDuplicates(["hash"])
    return generated(asked, "hash", "text", _asked, "prompt", "string")


def _asked(texts: list[str]) -> list[str]:
    from .providers.generate import Reviser

    chat = Reviser("hf", "none").chat
    return [chat(t) for t in texts]


@query(f"""WITH {CURVE} SELECT dataset AS "Dataset", upper(detector) AS "Detector", printf('%.4f', roc_auc) AS "ROC AUC",
{", ".join(f"printf('%.4f', a{i}) AS \"AUROC({q * 100})\"" for i, q in enumerate((0.001, 0.01, 0.1)))},
{", ".join(f"printf('%5.1f%%', t{i}) AS \"TPR(FPR={q * 100}%)\"" for i, q in enumerate((0.001, 0.01, 0.1)))} FROM r JOIN z ON r.dataset = z.d""")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """The console's table: labels of metrics and formatted values."""
    rows = E.displayed(E.metrics(_tied(spark, d)))
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"`{x}` string" for x in rows[0]))


@query("""SELECT item_id, 'out/set_' || item_id || '_scores' AS path, 'out/set_' || item_id || '_scores.debug' AS trial FROM benchmark""")
def scores_paths(spark: SparkSession, d: str) -> DataFrame:
    """Where scores of datasets that are no paths go, as expressions over their names."""
    from .sources import sinks

    key = sinks.name_key(F.concat(F.lit("set/"), F.col("item_id")))
    return _table(spark, d, "benchmark").select("item_id", sinks.scores_path("out", key).alias("path"), sinks.scores_path("out", key, True).alias("trial"))


@query(f"SELECT doc_id, {_punctuation_sql('en', True)} AS text FROM documents")
def mage_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", mage.punctuation(F.col("text")).alias("text"))


def _detokenised_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    text = "text"
    for old, new in mage.DETOKENISED:
        text = f"replace({text}, {quoted(old)}, {quoted(new)})"
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


@query(f"SELECT doc_id, {_detokenised_sql()} AS text FROM documents")
def mage_detokenised(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", mage.detokenised(F.col("text")).alias("text"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '' AND NOT list_contains(['a', 'and', 'from', 'of', 'that', 'the', 'to'], x)), ' ') AS tokens FROM documents")
def without_stop_words(spark: SparkSession, d: str) -> DataFrame:
    some = ["a", "and", "from", "of", "that", "the", "to"]
    return _table(spark, d, "documents").select("doc_id", F.concat_ws(" ", overlap.without(overlap.tokens(F.col("text")), some)).alias("tokens"))
