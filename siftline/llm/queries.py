"""The training-data queries and their SQL, by registered name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import bpe, chat_template, exact_dedup, language_id, license_scan, mixing, packing, prefix_trie, quality_model, quality_rules, simhash, spelling, suffix_tree


def suffix_tree_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_suffix_tree that SQL can express."""
    found = suffix_tree.op1_suffix_tree(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_license_scan that SQL can express."""
    return license_scan.op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


#: CRC-32 of a text's bytes below 128, by its table of 256 remainders.
CRC = """polynomial AS (
  SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS t(i))
), ids AS (
  SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda r, b: xor(crcs[xor(r, b) % 256 + 1], r // 256)), 4294967295) AS crc FROM documents, polynomial
)"""
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SUFFIX_TREE_BASE = rf"""
WITH {CRC}, tokens AS (
  SELECT doc_id, crc % 7 = 2 AS held_out, unnest(list_append(regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+'), '')) AS token FROM ids
), counts AS (
  SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token
), total AS (
  SELECT sum(c)::BIGINT AS n, count(*) AS v FROM counts
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 6) AS base_score
FROM tokens LEFT JOIN counts USING (token), total GROUP BY doc_id, held_out, n
"""
LICENSE_BASE = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, list_filter(range(len(w)), lambda k: w[k + 1] = 'mit' AND w[k + 2] = 'license') AS mit, list_filter(range(len(w)), lambda k: w[k + 1] = 'apache' AND w[k + 2] = 'license') AS apache,
    list_filter(range(len(w)), lambda k: w[k + 1] = 'general' AND w[k + 2] = 'public' AND w[k + 3] = 'license') AS gpl FROM w
)
SELECT doc_id, len(w) AS n_words, len(mit) + len(apache) + len(gpl) AS n_base, list_min(list_concat(mit, apache, gpl)) AS first_word, list_max(list_concat(mit, apache, gpl)) AS last_word,
  array_to_string(list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p
"""



def _xxh64(seed: int) -> str:
    """SQL of XXH64: hashed(key, x) from texts(key, text), by stripes of 32 bytes, then words of eight, of four, then bytes."""
    p1, p2, p3, p4, p5 = (f"{x}::UHUGEINT" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    top = "18446744073709551616::UHUGEINT"
    mul = lambda a, b: f"((({a}) * {b}) % {top})"  # noqa: E731
    add = lambda *x: f"(({' + '.join(f'({y})' for y in x)}) % {top})"  # noqa: E731
    turn = lambda a, n: f"((({a}) * {1 << n}) % {top} + ({a}) // {1 << (64 - n)})"  # noqa: E731
    little = lambda at, n: "('0x' || " + " || ".join(f"substr(h, {at} + {2 * k}, 2)" for k in range(n - 1, -1, -1)) + ")::UBIGINT::UHUGEINT"  # noqa: E731
    round_ = lambda v, x: mul(turn(add(v, mul(x, p2)), 31), p1)  # noqa: E731
    starts = [(seed + a) % (1 << 64) for a in (11400714785074694791 + 14029467366897019727, 14029467366897019727, 0, -11400714785074694791)]
    lanes = ", ".join(f"list_reduce(list_prepend({v}::UHUGEINT, [{little(f'64 * i + {16 * k + 1}', 8)} FOR i IN range(n // 32)]), lambda v, x: {round_('v', 'x')}) AS v{k}" for k, v in enumerate(starts))
    whole = add(*(turn(f"v{k}", n) for k, n in enumerate((1, 7, 12, 18))))
    for k in range(4):
        whole = add(mul(f"xor({whole}, {round_('0::UHUGEINT', f'v{k}')})", p1), p4)
    eights = f"list_reduce(list_prepend(a, [{little('n // 32 * 64 + 16 * i + 1', 8)} FOR i IN range(n % 32 // 8)]), lambda v, x: {add(mul(turn('xor(v, ' + round_('0::UHUGEINT', 'x') + ')', 27), p1), p4)})"
    four = f"CASE WHEN n % 8 >= 4 THEN {add(mul(turn('xor(b, ' + mul(little('n // 8 * 16 + 1', 4), p1) + ')', 23), p2), p3)} ELSE b END"
    ones = f"list_reduce(list_prepend(c, [('0x' || substr(h, n // 4 * 8 + 2 * i + 1, 2))::UBIGINT::UHUGEINT FOR i IN range(n % 4)]), lambda v, x: {mul(turn('xor(v, ' + mul('x', p5) + ')', 11), p1)})"
    return f"""bytes AS (SELECT text, hex(encode(text)) AS h, strlen(text) AS n FROM texts), lanes AS (SELECT *, {lanes} FROM bytes), sa AS (SELECT *, {add(f"CASE WHEN n >= 32 THEN {whole} ELSE {(seed + 2870177450012600261) % (1 << 64)}::UHUGEINT END", "n::UHUGEINT")} AS a FROM lanes),
sb AS (SELECT *, {eights} AS b FROM sa), sc AS (SELECT *, {four} AS c FROM sb), sd AS (SELECT *, {ones} AS d FROM sc), se AS (SELECT text, {mul("xor(d, d // 8589934592)", p2)} AS e FROM sd), sf AS (SELECT text, {mul("xor(e, e // 536870912)", p3)} AS f FROM se),
hashed AS (SELECT text, xor(f, f // 4294967296)::UBIGINT AS x FROM sf)"""


ORACLE_OP9 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^ 	-]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) > 2 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS text FROM w
), texts AS (
  SELECT DISTINCT text FROM shingles
), {_xxh64(42)}, prints AS (
  SELECT doc_id, {" + ".join(f"CASE WHEN 2 * sum((x >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))} AS fp FROM shingles JOIN hashed USING (text) GROUP BY doc_id
), p AS (
  SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM documents LEFT JOIN prints USING (doc_id)
), f AS (
  SELECT fp, min(doc_id) AS least FROM p GROUP BY fp
), near AS (
  SELECT a.fp AS a, b.fp AS b FROM f a JOIN f b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2
), reach AS (
  SELECT fp AS a, fp AS b FROM f UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b
), roots AS (
  SELECT reach.a AS fp, min(f.least) AS component_id FROM reach JOIN f ON f.fp = reach.b GROUP BY reach.a
)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM p JOIN roots USING (fp)
"""

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_suffix_tree": suffix_tree.op1_suffix_tree,
    "op2_packing": packing.op2_packing,
    "op3_language_id": language_id.op3_language_id,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_chat_template": chat_template.op5_chat_template,
    "op6_quality_model": quality_model.op6_quality_model,
    "op7_bpe": bpe.op7_bpe,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "suffix_tree_base": suffix_tree_base,
    "license_base": license_base,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_mixing": mixing.op13_mixing,
}

ORACLE_SQL = {
    "op5_chat_template": chat_template.ORACLE_OP5,
    "op8_exact_dedup": exact_dedup.ORACLE_OP8,
    "op9_simhash": ORACLE_OP9,
    "op10_quality_rules": quality_rules.ORACLE_OP10,
    "suffix_tree_base": SUFFIX_TREE_BASE,
    "license_base": LICENSE_BASE,
    "op11_prefix_trie": prefix_trie.ORACLE_OP11,
    "op12_spelling_variants": spelling.ORACLE_OP12,
    "op13_mixing": mixing.ORACLE_OP13,
}
