"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), num=85)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file, which every machine of the cluster has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.llm.tokens import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.llm.link_trust import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.llm.pii import replace_entities

    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_entities")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.llm.negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillframe.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents")).drop("n_random")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _url_sql() -> str:
    """The URL filter as SQL: rules, seeds and links as relations, and the steps of both walks as recursions."""
    from quillframe.llm.link_trust import DAMPING, LOWER, RULES, THRESHOLD, TOLERANCE, UPPER

    rules = sorted(RULES, key=lambda x: -len(x[0] + x[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in rules]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    steps = [
        f"""{walk} AS (
            SELECT 0 AS i, host, seed AS x FROM {seeds}
            UNION ALL
            SELECT i + 1, b, sum({DAMPING} * x * share) FROM {walk} JOIN {shares} ON a = host, steps WHERE i < n GROUP BY i, b
        ),
        {walk}_score AS (SELECT host, sum(x) AS score FROM {walk} GROUP BY host)"""
        for walk, seeds, shares in (("g", "good", "forward"), ("d", "bad", "backward"))
    ]
    return rf"""
        WITH RECURSIVE p AS (
            SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
        ),
        r AS (SELECT *, {case(1)} AS rule, {case(2)} AS said FROM p),
        h AS (SELECT host, count(*) AS n, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS b FROM r WHERE host <> '' GROUP BY host),
        good AS (SELECT host, 1.0::DOUBLE AS seed FROM h WHERE 2 * a > n), bad AS (SELECT host, 1.0::DOUBLE AS seed FROM h WHERE 2 * b > n),
        x AS (SELECT host AS a, translate(unnest(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)), '{UPPER}', '{LOWER}') AS b FROM p WHERE host <> ''),
        e AS (SELECT a, b, count(*) AS n FROM x WHERE a <> b GROUP BY a, b),
        forward AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS share FROM e), backward AS (SELECT b AS a, a AS b, n / sum(n) OVER (PARTITION BY b) AS share FROM e),
        steps AS (SELECT ceil(ln({TOLERANCE * THRESHOLD * (1 - DAMPING)} / greatest(1, count(*))) / ln({DAMPING}))::INT AS n FROM h),
        {", ".join(steps)},
        blocked AS (
            SELECT host FROM h JOIN d_score d USING (host) LEFT JOIN g_score g USING (host) WHERE d.score > {THRESHOLD} AND d.score > coalesce(g.score, 0)
            UNION SELECT host FROM bad
        )
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM r"""


def _secret_sql() -> str:
    """Secret scans as SQL: matches, gaps, runs and their symbols as relations."""
    from quillframe.llm.secrets import ACCESS, BATTERY, ENCODINGS, FORM, HEX, LAST, LEAST_VALUE, LENGTHS, RATE, RUN, STEPS, TEXT_MATCH

    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def cut(name: str, source: str, at: str, s: str, pattern: str) -> str:
        """The matches m and gaps g of a column of texts, with their places."""
        p = quoted(pattern)
        return f"""{name}_list AS (SELECT rid, {at} AS origin, regexp_extract_all({s}, {p}) AS ms, string_split_regex({s}, {p}) AS gs FROM {source}),
        {name}_row AS (SELECT rid, origin, unnest(gs) AS g, unnest(ms) AS m, unnest(range(1, len(gs) + 1)) AS i FROM {name}_list),
        {name} AS (SELECT rid, g, m, origin + sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY rid, origin ORDER BY i) AS stop FROM {name}_row)"""

    cases = lambda part: " ".join(f"WHEN {e} THEN {part(x)}" for e, x in enumerate(ENCODINGS))
    z = f"(bin::DOUBLE / {STEPS})"
    t = f"(1.0::DOUBLE / (abs({z}) * 0.2316419::DOUBLE + 1))"
    density = f"(exp(-abs({z}) * abs({z}) / 2) / 2.5066282746310002::DOUBLE)"
    poly = f"(((({t} * 1.330274429::DOUBLE - 1.821255978::DOUBLE) * {t} + 1.781477937::DOUBLE) * {t} - 0.356563782::DOUBLE) * {t} + 0.319381530::DOUBLE) * {t}"
    return rf"""
        WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS s FROM documents),
        {cut("a", "t", "0", "s", FORM)}, {cut("k", "t", "0", "s", ACCESS)}, {cut("x", "t", "0", "s", HEX)},
        base AS (
            SELECT rid, stop - length(m) AS start, 0 AS kind, stop FROM a WHERE m IS NOT NULL AND length(regexp_extract(m, {quoted(FORM)}, 2)) >= {LEAST_VALUE}
            UNION ALL SELECT rid, stop - length(m), 1, stop FROM k WHERE m IS NOT NULL UNION ALL SELECT rid, stop - length(m), 2, stop FROM x WHERE m IS NOT NULL
        ),
        pieces AS (SELECT rid, g AS piece, stop - coalesce(length(m), 0) - length(g) AS place FROM a),
        {cut("r", "pieces", "place", "piece", RUN)},
        run AS (SELECT row_number() OVER () AS no, rid, stop - length(m) AS start, stop, regexp_replace(m, '=+$', '') AS core FROM r WHERE m IS NOT NULL),
        typed AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(core, '{p}') THEN {e}" for e, (_, p, _, _) in enumerate(ENCODINGS))} END AS encoding FROM run WHERE NOT regexp_matches(core, '^(?:{ACCESS}|{HEX}|[0-9]+)$')),
        folded AS (SELECT *, length(core) AS n, CASE encoding {cases(lambda x: "lower(core)" if x[3] else "translate(core, '-_', '+/')")} END AS c, CASE encoding {cases(lambda x: f"'{x[2]}'")} END AS alphabet FROM typed),
        symbol AS (SELECT no, n, alphabet, i, instr(alphabet, c[i]) - 1 AS v FROM (SELECT no, n, alphabet, c, unnest(range(1, n + 1)) AS i FROM folded)),
        next AS (SELECT no, n, length(alphabet) AS k, v, coalesce(lead(v) OVER w, first_value(v) OVER w) AS after, lag(v) OVER w AS before FROM symbol WINDOW w AS (PARTITION BY no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        fact AS (
            SELECT no, any_value(k)::DOUBLE AS k, any_value(n)::DOUBLE AS n, sum(v)::DOUBLE AS s, sum(v * v)::DOUBLE AS q, sum(v * after)::DOUBLE AS p, count(*) FILTER (v >= k // 2)::DOUBLE AS b,
                   count(*) FILTER (before IS NULL OR (before >= k // 2) <> (v >= k // 2))::DOUBLE AS turns FROM next GROUP BY no
        ),
        equal AS (SELECT no, sum(c * c)::DOUBLE AS e FROM (SELECT no, v, count(*) AS c FROM symbol GROUP BY no, v) GROUP BY no),
        score AS (
            SELECT no, (e * k / n - n - (k - 1)) / sqrt((n - 1) * (2 * (k - 1)) / n) AS u,
                   CASE WHEN b * (n - b) * 2 * (b * (n - b) * 2 - n) > 0 THEN (turns - 1 - b * (n - b) * 2 / n) / sqrt(b * (n - b) * 2 * (b * (n - b) * 2 - n) / (n * n * (n - 1))) ELSE 100 END AS w,
                   CASE WHEN n * q - s * s > 0 THEN ((n * p - s * s) / (n * q - s * s) + 1 / (n - 1)) * (n - 1) * sqrt(n - 2) / n ELSE 100 END AS z,
                   (n * (n - 1) / 2 * h - (e - n) / 2 - 0.5::DOUBLE) / sqrt(n * (n - 1) / 2 * h * (1 - h)) AS far
            FROM (SELECT *, greatest(2 / k, {TEXT_MATCH!r}::DOUBLE) AS h FROM fact) JOIN equal USING (no)
        ),
        binned AS (
            SELECT no, rid, start, stop, encoding, len(list_filter([{", ".join(map(str, LENGTHS))}], lambda x: x < n)) AS size, u * u + w * w + z * z AS battery, floor(greatest(-1, least({LAST // STEPS}, far)) * {STEPS})::INT AS bin
            FROM score JOIN folded USING (no)
        ),
        ranked AS (SELECT *, count(*) OVER (PARTITION BY encoding, size ORDER BY bin DESC) AS above, count(*) OVER (PARTITION BY encoding, size) AS whole FROM binned),
        least AS (SELECT encoding, size, min(bin) AS least FROM ranked WHERE CASE WHEN bin < 0 THEN 1 - {density} * {poly} WHEN bin > {4 * STEPS} THEN {density} / abs({z}) ELSE {density} * {poly} END * whole <= above * {RATE} GROUP BY ALL),
        spans AS (SELECT * FROM base UNION ALL SELECT rid, start, 3, stop FROM binned JOIN least USING (encoding, size) WHERE battery <= {BATTERY} AND bin >= least),
        named AS (SELECT rid, kind, start, concat_ws(':', ['assign', 'access', 'hex', 'random'][kind + 1], start::BIGINT, stop::BIGINT) AS span FROM spans)
        SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
        FROM t LEFT JOIN named USING (rid) GROUP BY rid"""


QUERIES = {
    "pipeline": pipeline,
    "op8_quality": op8_quality,
    "op6_substring_dedup": op6_substring_dedup,
    "op1_near_dedup": op1_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op9_pii": op9_pii,
    "op3_top_k": op3_top_k,
    "op7_packing": op7_packing,
    "op2_token_counts": op2_token_counts,
    "op10_bpe_codec": op10_bpe_codec,
    "op4_exact_dedup": op4_exact_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_secrets": op13_secrets,
}

ORACLE = {
    "op5_url_filter": _url_sql(),
    "op13_secrets": _secret_sql(),
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND label IS NOT NULL
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
        ),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
            SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op6_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ),
        s AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w),
        h AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 34], ' ')) AS g FROM s),
        d AS (SELECT doc_id, i FROM h WHERE g IN (SELECT g FROM h GROUP BY g HAVING count(*) > 1)),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM d),
        l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN words
                   ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN l USING (doc_id)""",
    "op1_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ),
        s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w
        ),
        e AS (SELECT doc_id, unnest(shingles) AS g FROM s),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM shared JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.shingles) + len(y.shingles) - n)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT doc_id, len(shingles)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id,
               doc_id = (SELECT min(b) FROM reach WHERE a = doc_id) AS kept
        FROM s""",
    "op3_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
                   length(coalesce(text, '')) AS points
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER best AS kept, text_sha256
        FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)""",
}
