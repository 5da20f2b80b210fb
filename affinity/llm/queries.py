"""Queries over whole tables, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontamination, edits, embeddings, html_text, licenses, lm, packing, quality, ranked, simhash, toxicity
from .common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, marks.select("doc_id", "toxic"), ~held_out("doc_id", 4))
    found = toxicity.score(docs, model, threshold=0.3)
    return found.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", "predicted", "n_passages", "first_word", "last_word")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), bits=2, shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.conversations(chat.chain(rows, F.col("conv_id"), ["turn", "role", "text"])))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score_documents(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7))
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=20)


def op12_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.edited_pairs(table(spark, sf_dir, "documents"), digits=256)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024).drop("scans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_html": op2_html,
    "op3_embeddings": op3_embeddings,
    "op4_simhash": op4_simhash,
    "op5_licenses": op5_licenses,
    "op6_chat": op6_chat,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_lm": op10_lm,
    "op11_ranked": op11_ranked,
    "op12_edits": op12_edits,
    "op13_codes": op13_codes,
}

#: A text's length once escaped: a backslash more for each backslash and each control string.
ESCAPED = r"length(regexp_replace(replace({0}, '\', '\\'), '({1})', 'x\1', 'g'))"


def escaped(column: str) -> str:
    return ESCAPED.format(column, "|".join(re.escape(x).replace("'", "''") for x in chat.CONTROL))


def codes_sql(rounds: int = 4) -> str:
    """Assignments and means as one step after the other; a distance and its entry make one number."""
    out = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT vec_id, p, e[p * (len(e) // 4) + 1 : (p + 1) * (len(e) // 4)] AS v FROM kept, range(4) t(p))",
        "c0 AS MATERIALIZED (SELECT p, n - 1 AS entry, v FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS n FROM x) WHERE n <= 256)",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT x.vec_id, x.p, min(256 * (list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v)) + entry)::BIGINT AS best FROM x JOIN c{r} c ON c.p = x.p GROUP BY ALL)")
        if r < rounds:
            out.append(f"m{r} AS (SELECT p, entry, list(mean ORDER BY i) AS v FROM (SELECT p, entry, i, floor(sum(y) / count(*)) AS mean FROM (SELECT p, best % 256 AS entry, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM x JOIN a{r} USING (vec_id, p)) GROUP BY ALL) GROUP BY ALL)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT p, entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (p, entry))")
    coded = f"coded AS (SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)"
    return f"""WITH {", ".join(out)}, {coded}, books AS (SELECT sha256(string_agg(y::BIGINT, ',' ORDER BY p, entry, i)) AS codebooks_sha256 FROM (SELECT p, entry, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM c{rounds}))
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"""


ORACLES: dict[str, str] = {
    "op3_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        unit AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v WHERE list_inner_product(e, e) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.95),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id <= coalesce(low.b, vec_id) AS kept
        FROM v LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op6_chat": f"""
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(20 + {escaped("role")} + {escaped("text")})::BIGINT AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op11_ranked": r"""
        WITH word(name, id, term) AS (SELECT 'd', doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM documents
            UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark),
        posting AS (SELECT id AS doc_id, term, count(*) AS tf FROM word WHERE name = 'd' GROUP BY ALL),
        size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM posting GROUP BY doc_id), total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
        shift AS (SELECT doc_id, 75 + 25 * n * docs // terms AS m FROM size, total),
        weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), total),
        item AS (SELECT id AS item_id, term, count(*) AS c FROM word WHERE name = 'q' GROUP BY ALL),
        found AS (SELECT item_id, doc_id, sum(c * w * (1000000000 * tf // (1000 * tf + 12 * m)))::BIGINT AS score FROM item JOIN weight USING (term) JOIN posting USING (term) JOIN shift USING (doc_id) GROUP BY ALL)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM found WHERE score > 0) WHERE rank <= 20""",
    "op13_codes": codes_sql(),
}
