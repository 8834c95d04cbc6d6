"""Queries of the operators for training data: opN_<name> over whole tables, and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import centroids, chat, decontamination, hmm, middle, mixing, neardup, neighbours, repeats, secrets, suffixes, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), lambda i: (5.0, 2.0, 1.0)[i % 3])
    return mixing.taken(mixed).select("doc_id", "size", "source_size", "target", "taken")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(table(spark, sf_dir, "documents"), window=50)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    made = tokens.write_shards(table(spark, sf_dir, "documents"), path, end_id=2)
    return tokens.crc32_of(tokens.read_documents(spark, made)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    lexicon = toxicity.learn(docs, labels.filter(~held_out))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), n=2, threshold=0.8)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    even = F.pmod("conv_id", F.lit(2)) == 0
    made = chat.preferences(turns, F.shiftright("conv_id", 1), even)

    def spans(side: str):
        return F.concat_ws(",", F.transform(f"{side}_trained", lambda s: F.concat_ws(":", s["start"], s["end"]))).alias(f"{side}_trained")

    return made.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", "rejected", spans("chosen"), spans("rejected"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    trained = hmm.train(docs.filter(~held_out))
    scored = hmm.score(docs, trained)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=1, plain_from=90, spm_below=20)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.without_repeats(table(spark, sf_dir, "documents"), window=100)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dimension=64, scale=256, seed=2)
    rows = found.assigned().join(F.broadcast(found.described()), "cluster")
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_repeats": op2_repeats,
    "op3_tokens": op3_tokens,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_neighbours": op7_neighbours,
    "op8_neardup": op8_neardup,
    "op9_chat": op9_chat,
    "op10_hmm": op10_hmm,
    "op11_middle": op11_middle,
    "op12_suffixes": op12_suffixes,
    "op13_centroids": op13_centroids,
}

ORACLES: dict[str, str] = {
    "op2_repeats": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM k JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
    sha256(coalesce(CASE WHEN js IS NULL THEN array_to_string(ws, ' ')
        ELSE array_to_string(list_filter(ws, lambda x, i: NOT list_contains(js, i)), ' ') END, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
""",
    "op8_neardup": r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)
    UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
""",
    "op9_chat": r"""
WITH t AS (
    SELECT conv_id, conv_id >> 1 AS pair_id, conv_id % 2 AS side,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
        coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), m AS (
    SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k, coalesce(a.role = b.role AND a.text = b.text, false) AS same
    FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.k = b.k
), p AS (
    SELECT pair_id, CAST(coalesce(min(k) FILTER (WHERE NOT same), max(k) + 1) - 1 AS INTEGER) AS n_prompt_turns FROM m GROUP BY pair_id
), r AS (
    SELECT t.*, n_prompt_turns, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body,
        coalesce(sum(length('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)))
            OVER (PARTITION BY conv_id, k > n_prompt_turns ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM t JOIN p USING (pair_id)
)
SELECT pair_id, min(conv_id) FILTER (WHERE side = 0) AS chosen_id, min(conv_id) FILTER (WHERE side = 1) AS rejected_id, min(n_prompt_turns) AS n_prompt_turns,
    coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE side = 0 AND k <= n_prompt_turns), '') AS prompt,
    coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE side = 0 AND k > n_prompt_turns), '') AS chosen,
    coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE side = 1 AND k > n_prompt_turns), '') AS rejected,
    coalesce(string_agg((before + length(head)) || ':' || (before + length(head) + length(body)), ',' ORDER BY k)
        FILTER (WHERE side = 0 AND k > n_prompt_turns AND role = 'assistant'), '') AS chosen_trained,
    coalesce(string_agg((before + length(head)) || ':' || (before + length(head) + length(body)), ',' ORDER BY k)
        FILTER (WHERE side = 1 AND k > n_prompt_turns AND role = 'assistant'), '') AS rejected_trained
FROM r GROUP BY pair_id
""",
    "op11_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
        WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, substring(t, 1, least(x, y)) AS head, substring(t, least(x, y) + 1, abs(x - y)) AS body, substring(t, greatest(x, y) + 1) AS tail FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(x - y) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || body WHEN 'spm' THEN '<S>' || tail || '<P>' || head || '<M>' || body ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM c
""",
}

ORACLES["op12_suffixes"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
f AS (SELECT s, min({'d': doc_id, 'i': i}) AS first FROM w GROUP BY s HAVING count(*) > 1),
c AS (SELECT doc_id, i, i - lag(i, 1, -101) OVER (PARTITION BY doc_id ORDER BY i) > 100 AS fresh FROM w JOIN f USING (s) WHERE {'d': doc_id, 'i': i} <> first),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c) GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM r),
g AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
    FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def _centroid_rounds(rounds: int = 5) -> str:
    """Statement of op13: a pair of steps for each round, and the last assignment."""
    out = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, x AS c FROM v QUALIFY k < 40)"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min({{'d': d, 'k': k}}) AS b FROM (SELECT vec_id, x, k, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM v, c{r}) GROUP BY vec_id)"""
        if r < rounds:
            out += f""",
m{r} AS (SELECT k, j, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT b.k AS k, unnest(x) AS x, unnest(range(64)) AS j FROM a{r}) GROUP BY k, j),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(list(CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT) ORDER BY j) FILTER (WHERE s IS NOT NULL), any_value(c)) AS c
    FROM c{r} LEFT JOIN m{r} USING (k) GROUP BY c{r}.k)"""
    return out + f"""
SELECT vec_id, CAST(b.k AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia,
    CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON k = b.k
"""


ORACLES["op13_centroids"] = _centroid_rounds()
