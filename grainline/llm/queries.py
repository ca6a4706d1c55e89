"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, cws, exact_dedup, iceberg_terms, lang_kernel, mixing, ngram_join, prefix_trie, quality_rules, substring_dedup, suffix_lm, toxicity, warc


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The public tokenizer's file: in the folder GRAINLINE_TOKENIZERS if set, else where the package public_tokenizers has it."""
    if folder := os.environ.get("GRAINLINE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), window=35)


def op2_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score_held_out(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return best_fit.pack_documents(docs, tokenizer_path(), max_len=4096, eos=1)


def op4_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_kernel.predict(table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive(spark, table(spark, sf_dir, "pages"), min_payload=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op10_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("enter", "exit")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("n_lines", "reason")


def op13_iceberg_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iceberg_terms.audit(table(spark, sf_dir, "documents"), min_docs=3, top=200)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_tree_lm": op2_suffix_tree_lm,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_kernel": op4_language_kernel,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_toxicity_machine": op6_toxicity_machine,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_weighted_fingerprints": op10_weighted_fingerprints,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_quality_rules": op12_quality_rules,
    "op13_iceberg_terms": op13_iceberg_terms,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: RFC 4648 base32 of 40 hex digits, four letters from every five digits.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {5 * (3 - j)}) & 31)::INT, 1)"
    for k in range(8)
    for j in range(4)
)

#: CRC-32 of a string of ASCII characters s, bit by bit.
_CRC32 = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))"

#: The rules' cutoffs as rows (rule, place, cutoff).
_CUTOFFS = ", ".join(f"('{rule}', {place}, {x})" for rule, (_, _, grid) in quality_rules.RULES.items() for place, x in enumerate(grid))
_RULE_SHARE = quality_rules.RISK / len(quality_rules.RULES)

ORACLE = {
    "op1_substring_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS gram FROM p),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
        cs AS (SELECT doc_id, list(k) AS ks FROM c GROUP BY doc_id),
        kept AS (SELECT w.doc_id, len(ws) AS n_words, CASE WHEN ks IS NULL THEN ws
                 ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda k: NOT list_contains(ks, k)), lambda k: ws[k]) END AS left_over
                 FROM w LEFT JOIN cs USING (doc_id))
        SELECT doc_id, n_words::BIGINT AS n_words, (n_words - len(left_over))::BIGINT AS n_removed,
               sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept""",
    "op5_warc_revisits": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY html, page_id ORDER BY url) AS k FROM pages),
        d AS (SELECT page_id, html, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS f, k FROM p)
        SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id IS DISTINCT FROM f OR (k > 1 AND f IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM f OR (k > 1 AND f IS NOT NULL) THEN f END AS refers_to
        FROM d""",
    "op7_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOWERED} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op8_source_mixing": f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                          ('0x' || substr(md5(concat_ws('|', 'mix', doc_id)), 1, 15))::BIGINT AS h, count(*) OVER () AS rows_n FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
        r AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 3 * source_size::DOUBLE AS cap FROM s),
        l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
        b AS (SELECT min_by(level, cap / weight) AS best FROM l WHERE level * weight <= cap),
        t AS (SELECT source, source_size, least(cap, coalesce(best * weight, cap)) AS target FROM l CROSS JOIN b),
        sh AS (SELECT *, round(target)::BIGINT AS wanted,
                      round(sum(target) OVER (ORDER BY source NULLS LAST) / sum(target) OVER () * {mixing.PERIOD})::BIGINT AS high FROM t WHERE target > 0),
        shares AS (SELECT *, lag(high, 1, 0) OVER (ORDER BY source NULLS LAST) AS low FROM sh),
        slots AS (SELECT i, (i % {mixing.PERIOD} * {mixing.GOLDEN}) % {mixing.PERIOD} AS point
                  FROM (SELECT unnest(range((SELECT ((sum(size) + {mixing.BLOCK_TOKENS - 1}) // {mixing.BLOCK_TOKENS})::BIGINT FROM d))) AS i)),
        met AS (SELECT source, wanted, i AS slot, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS rank FROM slots JOIN shares ON point >= low AND point < high),
        n_met AS (SELECT s.source, s.wanted, count(m.rank) AS n FROM shares s LEFT JOIN met m ON m.source IS NOT DISTINCT FROM s.source GROUP BY 1, 2),
        blocks AS (SELECT source, wanted, rank, slot FROM met
                   UNION ALL SELECT source, wanted, rank, (SELECT count(*) FROM slots) + rank - n FROM (SELECT *, unnest(range(n, (wanted + {mixing.BLOCK_TOKENS - 1}) // {mixing.BLOCK_TOKENS})) AS rank FROM n_met)),
        placed AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY h % ((rows_n + {mixing.ROWS_PER_BUCKET - 1}) // {mixing.ROWS_PER_BUCKET}), h, doc_id) - size)::BIGINT AS start FROM d),
        laid AS (SELECT p.doc_id, p.source, size, unnest(range(0, (wanted - 1) // source_size + 1)) * source_size + start AS a
                 FROM placed p JOIN shares k ON k.source IS NOT DISTINCT FROM p.source WHERE size > 0 AND wanted > 0),
        spans AS (SELECT *, unnest(range(a // {mixing.BLOCK_TOKENS}, (a + size - 1) // {mixing.BLOCK_TOKENS} + 1)) AS block FROM laid),
        got AS (SELECT doc_id, sum(least(a + size, (k.rank + 1) * {mixing.BLOCK_TOKENS}, wanted) - greatest(a, k.rank * {mixing.BLOCK_TOKENS}))::BIGINT AS taken, min(k.slot) AS first_slot
                FROM spans p JOIN blocks k ON k.rank = p.block AND k.source IS NOT DISTINCT FROM p.source WHERE greatest(a, k.rank * {mixing.BLOCK_TOKENS}) < wanted GROUP BY 1)
        SELECT d.doc_id, d.size::BIGINT AS size, source_size, target, coalesce(taken, 0) AS taken, first_slot
        FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source LEFT JOIN got ON got.doc_id IS NOT DISTINCT FROM d.doc_id""",
    "op9_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        g AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5
                THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
        s AS (SELECT doc_id, count(*) AS n, string_agg(gram, '|' ORDER BY gram) AS whole FROM g GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM common JOIN s p ON p.doc_id = x JOIN s q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-6),
        reach AS (
            SELECT doc_id AS node, doc_id AS low FROM documents
            UNION SELECT l.y, r.low FROM reach r JOIN links l ON l.x = r.node WHERE r.low < l.y)
        SELECT d.doc_id, (SELECT min(low) FROM reach r WHERE r.node = d.doc_id) AS class_id,
               coalesce((SELECT min(o.doc_id) FROM s o JOIN s m ON m.whole = o.whole WHERE m.doc_id = d.doc_id), d.doc_id) AS rep_id,
               (SELECT count(*) FROM links l WHERE l.x = d.doc_id) AS n_links
        FROM documents d""",
    "op11_prefix_trie": f"""
        WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, conv_id - conv_id % 20 AS base,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT c, any_value(base) AS base, xor({_CRC32.format(s='c::VARCHAR')}, 4294967295) % 4 AS h FROM o GROUP BY c),
        b AS (SELECT k.c, 0 AS part, o.i, o.role, o.text FROM k JOIN o ON o.c = k.base AND o.i <= k.h UNION ALL SELECT k.c, 1, o.i, o.role, o.text FROM k JOIN o ON o.c = k.c AND o.i > k.h),
        r AS (SELECT c, row_number() OVER w AS d, sha256(length(role) || ':' || role || text) AS x, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM b WINDOW w AS (PARTITION BY c ORDER BY part, i)),
        m AS (SELECT c, d, words, string_agg(x, '') OVER (PARTITION BY c ORDER BY d) AS prefix FROM r UNION ALL SELECT c, 0, 0, '' FROM k),
        e AS (SELECT c, max(d) AS d FROM m GROUP BY c),
        v AS (SELECT m.*, min(c) OVER (PARTITION BY prefix) AS node, m.d = e.d AS last FROM m JOIN e USING (c)),
        n AS (SELECT node, d, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '') AS ends FROM v GROUP BY node, d),
        u AS (SELECT n.*, p.node AS parent FROM n LEFT JOIN v p ON p.c = n.node AND p.d = n.d - 1),
        kids AS (SELECT parent, d - 1 AS d, count(*) AS n FROM u WHERE parent IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT u.*, coalesce(kids.n, 0) AS n_children FROM u LEFT JOIN kids ON kids.parent = u.node AND kids.d = u.d),
        sub AS (SELECT a.node, a.d, count(*) FILTER (WHERE t.n_children = 0) AS leaves, sum(t.saved) AS saved FROM t JOIN v a ON a.c = t.node AND a.d <= t.d GROUP BY 1, 2)
        SELECT t.node AS conv_id, t.d::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
        FROM t JOIN sub USING (node, d)""",
    "op12_quality_rules": f"""
        WITH w AS (SELECT row_number() OVER () AS id, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        u AS (SELECT id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
        g AS (SELECT id, i, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM u WINDOW o AS (PARTITION BY id ORDER BY i)),
        r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, word, second, third) AS n FROM g WHERE third IS NOT NULL) WHERE n > 1),
        c AS (SELECT id, count(DISTINCT k) AS n FROM (SELECT id, unnest(range(i, i + 3)) AS k FROM r) GROUP BY id),
        l AS (SELECT id, count(*) AS n, count(DISTINCT line) AS kinds FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY id),
        f AS (SELECT w.id, doc_id, lang, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     coalesce(l.n, 0) AS n_lines, coalesce(l.n - l.kinds, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, ('0x' || substr(md5(text), 1, 15))::BIGINT AS text_key FROM w LEFT JOIN c ON c.id = w.id LEFT JOIN l ON l.id = w.id),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                     [{{'rule': 'symbols', 'a': n_symbols, 'b': n_words}}, {{'rule': 'long_words', 'a': word_chars, 'b': n_words}}, {{'rule': 'repeated_lines', 'a': n_dup_lines, 'b': n_lines}}, {{'rule': 'repeated_words', 'a': n_repeat_words, 'b': n_words}}] AS ratios FROM f),
        q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1),
        t AS (SELECT lang, text_key, max(quality) > 0 AS good, any_value(ratios) AS ratios FROM b JOIN q USING (doc_id) WHERE NOT base_failed GROUP BY 1, 2),
        e AS (SELECT lang, good, text_key % {quality_rules.FOLDS} <> 0 AS held, unnest(ratios) AS x FROM t),
        grid AS (SELECT * FROM (VALUES {_CUTOFFS}) v(rule, place, cutoff)),
        curve AS (SELECT lang, rule, place, cutoff, count(*) FILTER (WHERE held AND good) AS n, count(*) FILTER (WHERE held AND good AND x.a * 1000 > x.b * cutoff) AS k,
                         count(*) FILTER (WHERE NOT held AND NOT good AND x.a * 1000 > x.b * cutoff) - {quality_rules.GOOD_COST} * count(*) FILTER (WHERE NOT held AND good AND x.a * 1000 > x.b * cutoff) AS gain
                  FROM e JOIN grid ON grid.rule = x.rule GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (WHERE held AND good) > 0),
        tail AS (SELECT *, CASE WHEN k >= n * {_RULE_SHARE} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - lgamma(n - i + 1) + i * ln({_RULE_SHARE}) + (n - i) * ln(1 - {_RULE_SHARE})))) END AS p FROM curve),
        ok AS (SELECT *, bool_and(p <= {quality_rules.DELTA} / ((SELECT count(DISTINCT lang) FROM curve) * {len(quality_rules.RULES)})) OVER (PARTITION BY lang, rule ORDER BY place DESC) AS ok FROM tail),
        best AS (SELECT lang, rule, cutoff FROM ok WHERE ok AND gain > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, place DESC) = 1),
        bad AS (SELECT DISTINCT id FROM (SELECT id, lang, unnest(ratios) AS x FROM b) y JOIN best ON best.lang = y.lang AND best.rule = x.rule WHERE x.a * 1000 > x.b * cutoff)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND id NOT IN (SELECT id FROM bad) AS kept FROM b""",
    "op13_iceberg_terms": """
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
        t AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
        c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY 1, 2, 3),
        g AS (SELECT d.lang, d.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) + (SELECT count(*) FROM k WHERE k.lang = d.lang) AS size,
                     (SELECT coalesce(sum(total), 0) + count(*) FROM k WHERE k.lang = d.lang) AS lang_size FROM (SELECT DISTINCT lang, source FROM d) d),
        p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // size AS p, 1 + (1000000000::HUGEINT * (total + 1)) // lang_size AS q
              FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM x QUALIFY part = 'pair' OR rank <= 200""",
}
