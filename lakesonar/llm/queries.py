"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesonar.session import ship_package

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def unit_sql(text: str) -> str:
    """A text hashed to (0, 1), as common.unit_hash does."""
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


# 3 -------------------------------------------------------------------------

SHARDS = 24


def _sharding_sql() -> str:
    score = unit_sql("k || ':' || s")
    return f"""
WITH d AS MATERIALIZED (SELECT *, coalesce(doc_id::VARCHAR, '') AS k, row_number() OVER () AS r FROM documents),
scored AS (SELECT r, s, -ln({score}) AS score FROM d, range(0, {SHARDS + 1}) t(s)),
won AS (SELECT r, arg_min(s, score) FILTER (s < {SHARDS}) AS shard, arg_min(s, score) AS grown FROM scored GROUP BY r),
texts AS (SELECT r, [('0x' || h)::BIGINT for h in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS b FROM d),
tab AS (SELECT list(list_reduce(list_prepend(n, range(0, 8)), lambda c, j:
          xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY n) AS t FROM range(0, 256) x(n)),
crc AS (SELECT r, xor(list_reduce(list_prepend(4294967295, b), lambda c, b:
          xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM texts, tab)
SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size, coalesce(crc, 0)::BIGINT AS text_crc32,
  'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, octet_length(encode(coalesce(text, '')))) - 1 AS slot,
  grown::INT AS grown_shard
FROM d JOIN won USING (r) LEFT JOIN crc USING (r)"""


@query("op3_rendezvous_sharding", _sharding_sql())
def op3(spark, sf_dir):
    from lakesonar.llm.sharding import manifest
    return manifest(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


# 10 ------------------------------------------------------------------------

MIX_SEED = "mix"

MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS r
        FROM d GROUP BY source),
capped AS (SELECT *, [5.0, 2.0, 1.0][(r % 3) + 1]::DOUBLE AS w, 3 * s::DOUBLE AS cap FROM per),
levels AS (SELECT *, ((SELECT sum(s) FROM per)::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM capped),
targets AS (SELECT source, s, least(cap, w * (SELECT max(lv) FROM levels)) AS target FROM levels),
numbered AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS i, floor(target + 0.5)::BIGINT AS quota,
  greatest(1, least(greatest(16384, ceil(sum(s) OVER () * 3 / 65536)), ceil(s * 3 / 64)))::BIGINT AS bw FROM targets),
line AS MATERIALIZED (SELECT row_number() OVER () AS id, d.doc_id, d.size, t.*,
  coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY {unit_sql(f"'{MIX_SEED}:line:' || coalesce(doc_id::VARCHAR, '')")}, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN numbered t ON d.source IS NOT DISTINCT FROM t.source),
pieces AS MATERIALIZED (SELECT *, before + k * s AS at_word, ((before + k * s) // bw)::BIGINT AS block FROM line, range(0, 3) x(k) WHERE size > 0),
blocks AS (SELECT i, block, sum(size) AS n, min(at_word) AS first FROM pieces GROUP BY i, block),
permuted AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY i ORDER BY
  {unit_sql(f"'{MIX_SEED}:block:' || i || ':' || block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM blocks),
takes AS (SELECT id, sum(greatest(0, least(size, quota - earlier - (at_word - first)))) AS taken
  FROM pieces JOIN permuted USING (i, block) GROUP BY id)
SELECT doc_id, size, s AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM line LEFT JOIN takes USING (id)"""


@query("op10_hypergeometric_mixing", MIX_SQL)
def op10(spark, sf_dir):
    from lakesonar.llm.mixing import mix, taken_words
    return taken_words(mix(table(spark, sf_dir, "documents"), seed=MIX_SEED))


# 6 -------------------------------------------------------------------------

def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_bitplane_tokens")
def op6(spark, sf_dir):
    from lakesonar.llm.tokens import encode_to_files
    return encode_to_files(table(spark, sf_dir, "documents"), tokenizer_path())


# 5 -------------------------------------------------------------------------

_NORMAL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
DECONTAMINATION_SQL = f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_NORMAL} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM windows),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_NORMAL} AS w FROM documents),
places AS (SELECT r, k, i, list_slice(w, i, i + k - 1) AS win
  FROM docs, lengths, unnest(range(1, len(w) - k + 2)) t(i) WHERE len(w) >= k),
found AS (SELECT r, p.k, i, item_id FROM places p JOIN windows USING (k, win)),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + k)) t(j) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l
  FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)"""


@query("op5_automaton_decontamination", DECONTAMINATION_SQL)
def op5(spark, sf_dir):
    from lakesonar.llm.decontaminate import match
    found = match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


# 9 -------------------------------------------------------------------------

def _fingerprint_sql(text: str) -> str:
    from lakesonar.llm.merkle import LEAF

    def joined(hashes):
        return f"md5(array_to_string({hashes}, ''))"
    leaves = f"[md5(x) for x in regexp_extract_all(p, '{LEAF}')]"
    paragraph, lines = joined(leaves), "string_split(s, chr(10))"
    section, sections = joined(f"[{paragraph} for p in {lines}]"), f"string_split({text}, chr(10) || chr(10))"
    return f"""{joined(f"[{section} for s in {sections}]")} || ':' || array_to_string([left({section}, 8) || '=' || array_to_string(
  [left({paragraph}, 8) || '~' || array_to_string([left(h, 8) for h in {leaves}], ',') for p in {lines}], '|') for s in {sections}], ';')"""


def _likeness_sql(a: str, b: str) -> str:
    la, lb = (f"list_distinct(regexp_extract_all(regexp_replace(substr({x}, 34), '[0-9a-f]+[=~]', '', 'g'), '[0-9a-f]+'))" for x in (a, b))
    return (f"CASE WHEN left({a}, 32) = left({b}, 32) THEN 1.0::DOUBLE ELSE "
            f"len(list_intersect({la}, {lb}))::DOUBLE / greatest(len({la}), len({lb})) END")


def _first_differing_sql(a: str, b: str) -> str:
    """The 1-based place of the first node that differs in two lists of nodes."""
    return (f"list_position([left({a}[i], 8) IS DISTINCT FROM left({b}[i], 8) "
            f"for i in range(1, greatest(len({a}), len({b})) + 1)], true)")


MERKLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT r, doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST),
  first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST)) AS nxt FROM d),
e AS (SELECT *, left(text, n - n // 3) || left(nxt, n // 3) AS edited FROM n),
f AS MATERIALIZED (SELECT *, {_fingerprint_sql('text')} AS fp, {_fingerprint_sql('edited')} AS ef, {_fingerprint_sql('nxt')} AS nf FROM e),
s AS (SELECT r, string_split(substr(fp, 34), ';') AS a, string_split(substr(ef, 34), ';') AS b FROM f WHERE left(fp, 32) <> left(ef, 32)),
s1 AS (SELECT *, {_first_differing_sql('a', 'b')} AS i FROM s),
p AS (SELECT r, i, string_split(substr(a[i], 10), '|') AS a, string_split(substr(b[i], 10), '|') AS b FROM s1 WHERE i <= least(len(a), len(b))),
p1 AS (SELECT *, {_first_differing_sql('a', 'b').replace('[i]', '[k]').replace('for i in', 'for k in')} AS j FROM p),
l AS (SELECT r, i, j, string_split(substr(a[j], 10), ',') AS a, string_split(substr(b[j], 10), ',') AS b FROM p1 WHERE j <= least(len(a), len(b))),
l1 AS (SELECT r, j, {_first_differing_sql('a', 'b').replace('[i]', '[k]').replace('for i in', 'for k in')} AS m FROM l)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, ef AS edited_fingerprint,
  {_likeness_sql('fp', 'ef')} AS near_edited, {_likeness_sql('fp', 'nf')} AS near_next,
  s1.i - 1 || coalesce('/' || (p1.j - 1) || coalesce('/' || (m - 1), ''), '') AS first_edit
FROM f LEFT JOIN s1 USING (r) LEFT JOIN p1 USING (r) LEFT JOIN l1 USING (r)"""


@query("op9_merkle_fingerprints", MERKLE_SQL)
def op9(spark, sf_dir):
    from lakesonar.llm.merkle import fingerprint_edits
    return fingerprint_edits(table(spark, sf_dir, "documents"))


# 1 and 2 -------------------------------------------------------------------

def remainder(divisor: int):
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    from lakesonar.llm.common import id_text
    return F.pmod(F.crc32(id_text()), F.lit(divisor))


@query("op1_backoff_langid")
def op1(spark, sf_dir):
    from lakesonar.llm.langid import learn, predict_column
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(4) == 2
    model = learn(docs.filter(~held_out).select("text", "lang"))
    return docs.select("doc_id", held_out.alias("held_out"), predict_column(spark, model, F.col("text")).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


@query("op2_factorization_toxicity")
def op2(spark, sf_dir):
    from lakesonar.llm.toxicity import learn, score_column
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = learn(docs, labels.filter(remainder(5) != 0))
    return docs.select("doc_id", (remainder(5) == 0).alias("held_out"),
                       score_column(spark, machine, F.col("text")).alias("score")).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# 4 -------------------------------------------------------------------------

@query("op4_covering_simhash")
def op4(spark, sf_dir):
    from lakesonar.llm.simhash import hex_digits, near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


# 8 -------------------------------------------------------------------------

SUBSTRING_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
win AS MATERIALIZED (SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
  FROM d, unnest(range(1, len(w) - 48)) t(i) WHERE len(w) >= 50),
least AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
gone AS (SELECT r, list(DISTINCT j) AS js FROM win JOIN least USING (h), unnest(range(i, i + 50)) t(j)
  WHERE least < doc_id GROUP BY r),
kept AS (SELECT r, list_filter(w, lambda x, j: NOT list_contains(js, j)) AS k FROM d JOIN gone USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE k END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)"""


@query("op8_countmin_substrings", SUBSTRING_SQL)
def op8(spark, sf_dir):
    from lakesonar.llm.substrings import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"))


# 7 -------------------------------------------------------------------------

def _reputation_sql() -> str:
    from lakesonar.llm.reputation import LOWER, RULES, SUFFIXES, UPPER
    labels = "string_split(host, '.')"
    pair = f"array_to_string(list_slice({labels}, -2, -1), '.')"
    double = f"{pair} IN ({', '.join(repr(x) for x in SUFFIXES)})"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    strength = "least(greatest(CASE WHEN f > 0 AND q - e > 0 THEN f / (q - e) - 1 ELSE 1000.0 END, 1.0), 1000.0)"

    def level(name, keys, parent, on):
        ks = ", ".join(keys)
        return f"""
{name}_u AS (SELECT {ks}, sum(g) AS g, sum(n) AS n, any_value(p.m) AS m FROM hosts h {parent} GROUP BY {ks}),
{name}_s AS (SELECT {strength} AS s FROM (SELECT sum(n * (g / n - m) ** 2) AS q, sum(m * (1 - m)) AS e,
  sum((n - 1) * m * (1 - m)) AS f FROM {name}_u WHERE n > 0)),
{name}_l AS (SELECT {ks}, g + s * m AS a, n - g + s * (1 - m) AS b, a / (a + b) AS m FROM {name}_u, {name}_s)"""

    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u)),
rules(h, pre, v) AS (VALUES {rules}),
fits AS (SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(v, length(h || pre)) AS v
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id),
r AS (SELECT p.*, rule, v FROM p LEFT JOIN fits USING (page_id)),
hosts AS (SELECT host, coalesce(sum(CASE v WHEN 'allow' THEN 1 WHEN 'block' THEN 0 END), 0)::DOUBLE AS g, count(v)::DOUBLE AS n,
  CASE WHEN {double} THEN {pair} ELSE {labels}[-1] END AS suffix,
  CASE WHEN {double} THEN array_to_string(list_slice({labels}, -3, -1), '.') ELSE {pair} END AS domain FROM r GROUP BY host),
top AS (SELECT (sum(g) + 1) / (sum(n) + 2) AS m FROM hosts),{level('x', ['suffix'], ', top p', '')},{
level('y', ['suffix', 'domain'], 'JOIN x_l p USING (suffix)', '')},{
level('z', ['suffix', 'domain', 'host'], 'JOIN y_l p USING (suffix, domain)', '')}
SELECT page_id, r.host, path, rule, coalesce(v, CASE WHEN m - 1.645 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) >= 0.5
  THEN 'allow' ELSE 'block' END) AS verdict FROM r JOIN z_l USING (host)"""


@query("op7_bayes_url_filter", _reputation_sql())
def op7(spark, sf_dir):
    from lakesonar.llm.reputation import judge
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


# 12 ------------------------------------------------------------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tree_sql(name: str, levels: int) -> str:
    """Levels ``{name}0`` .. of a tree of runs of 8 over {name}0 (g, i, node), with sibling segments in {name}s0 .."""
    out = ""
    for j in range(levels):
        run = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
        out += f""",
{name}s{j} AS MATERIALIZED (SELECT g, i, node, count(*) OVER (PARTITION BY g) > 1 AS act,
  coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{j}),
{name}{j + 1} AS MATERIALIZED (SELECT g, i // 8 AS i, CASE WHEN any_value(act) THEN sha256(string_agg(node, '' ORDER BY i))
  ELSE any_value(node) END AS node FROM {name}s{j} GROUP BY g, i // 8)"""
    return out


def _fold_sql(name: str, tree: str, levels: int) -> str:
    return "".join(f""",
{name}{j + 1} AS MATERIALIZED (SELECT f.id, f.g, f.i // 8 AS i, CASE WHEN act THEN sha256(l || f.node || r) ELSE f.node END AS node,
  proof || CASE WHEN act THEN l || r ELSE '' END AS proof FROM {name}{j} f JOIN {tree}s{j} s ON f.g = s.g AND f.i = s.i)""" for j in range(levels))


def _manifest_sql() -> str:
    def row_hash(text):
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
                                       for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    return f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(n, range(0, 8)), lambda c, j:
       xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY n) AS t FROM range(0, 256) x(n)),
d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce('1' || lang, '0') AS g, {row_hash('text')} AS leaf,
  {row_hash(f"translate(text, '{UPPER}', '{LOWER}')")} AS low, xor(list_reduce(list_prepend(4294967295,
    [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, tab),
a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
x0 AS (SELECT g, i, leaf AS node FROM a){_tree_sql('x', 7)},
y0 AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(x7.g)) - 1 AS i, node FROM x7){_tree_sql('y', 3)},
places AS (SELECT x7.g AS og, '' AS g, row_number() OVER (ORDER BY encode(x7.g)) - 1 AS i, node AS subroot FROM x7),
f0 AS (SELECT id, g, i, CASE WHEN crc % 3 = 0 THEN low ELSE leaf END AS node, '' AS proof FROM a){_fold_sql('f', 'x', 7)},
h0 AS (SELECT f.id, p.g, p.i, f.node, f.proof FROM f7 f JOIN places p ON f.g = p.og){_fold_sql('h', 'y', 3)}
SELECT doc_id, leaf, subroot, y3.node AS root, sha256(h.proof) AS proof_sha256, h.node AS folded_root, h.node = y3.node AS verified
FROM a JOIN h3 h USING (id) JOIN places p ON a.g = p.og, y3"""


@query("op12_concatenated_manifest", _manifest_sql())
def op12(spark, sf_dir):
    from lakesonar.llm.manifest import FIELDS, folded, leaf, manifest, proof
    docs = table(spark, sf_dir, "documents")
    lowered = leaf([F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS])
    tampers = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = manifest(docs, extra={"tampered": F.when(tampers, lowered)})
    back = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
                       back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


# 13 ------------------------------------------------------------------------

def _repair_sql() -> str:
    """A forward DP, one row of a conversation a step: the state's cost, audit and repaired text as one string
    (8 digits, the audit, chr(1), the text), whose least is the cheapest, ties by audit."""
    sep = "chr(1)"

    def goes(s, k, letter, piece=None):
        at = f"instr({s}, {sep})"
        body = f"substr({s}, {at})" if piece is None else (
            f"substr({s}, {at}) || CASE WHEN length({s}) > {at} THEN chr(10) ELSE '' END || {piece}")
        return (f"(printf('%08d', substr({s}, 1, 8)::INT + {k}) || substr({s}, 9, {at} - 9) || '{letter}' || {body})")

    def inserted(a):  # states with inserts in front: b0 .. b3
        user, other = ({n: goes(n, 2, "I", f"'{r}:'") for n in a} for r in ("user", "assistant"))
        two = f"least({a[2]}, {user[a[0]]}, {user[a[1]]}, {user[a[3]]})"
        two_step = f"least({a[3]}, {other[a[2]]}, {goes(user[a[0]], 2, 'I', chr(39) + 'assistant:' + chr(39))}, {goes(user[a[1]], 2, 'I', chr(39) + 'assistant:' + chr(39))})"
        return f"{a[0]} AS b0, {a[1]} AS b1, {two} AS b2, {two_step} AS b3"

    whole, extra = "(role || ':' || text)", "(CASE WHEN f = 3 THEN 1 ELSE 0 END)"
    stays = "f IN (0, 3)"

    def step(to):
        start = {1: ["b0"], 2: ["b0", "b1", "b3"], 3: ["b2"], 0: []}[to]
        initial, role = {1: "s", 2: "u", 3: "a", 0: "-"}[to], {2: "user", 3: "assistant"}.get(to)
        ways = [goes(f"b{to}", 3, "D")]
        ways += [f"CASE WHEN {stays} AND i = '{initial}' THEN {goes(b, extra, 'K', whole)} END" for b in start]
        if role:
            ways += [f"CASE WHEN {stays} THEN {goes(b, f'2 + {extra}', 'R', chr(39) + role + ':' + chr(39) + ' || text')} END" for b in start]
        return f"least({', '.join(ways)}, NULL) AS s{to}"

    return f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(n, range(0, 8)), lambda c, j:
       xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY n) AS t FROM range(0, 256) x(n)),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295,
  [ascii(c)::BIGINT for c in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM conversations, tab),
rows0 AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
  CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src, range(0, 2) c(k) WHERE d <> 0 AND (k = 0 OR d = 3)),
ids AS MATERIALIZED (SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
rows1 AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS n
  FROM rows0 r JOIN ids ON r.conv_id IS NOT DISTINCT FROM ids.conv_id),
faults AS MATERIALIZED (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS f,
  coalesce(lag(left(role, 1)) OVER (PARTITION BY c ORDER BY n), '') AS p FROM rows1),
stats AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (f = 1) AS blank,
  count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
  count(*) FILTER (n > 1 AND p || i NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY c),
dp AS (SELECT c, 0::BIGINT AS n, '00000000' || {sep} AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM ids
  UNION ALL SELECT c, n, {step(0)}, {step(1)}, {step(2)}, {step(3)}
  FROM (SELECT r.*, {inserted(['s0', 's1', 's2', 's3'])} FROM dp JOIN faults r ON r.c = dp.c AND r.n = dp.n + 1)),
won AS (SELECT c, least(b0, b3) AS s FROM (SELECT c, {inserted(['s0', 's1', 's2', 's3'])} FROM
  (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC) AS z FROM dp) WHERE z = 1))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, substr(s, 1, 8)::BIGINT AS cost,
  substr(s, 9, instr(s, {sep}) - 9) AS audit, sha256(substr(s, instr(s, {sep}) + 1)) AS repaired_sha256
FROM ids JOIN won USING (c) LEFT JOIN stats USING (c)"""


@query("op13_path_ranked_repair", _repair_sql())
def op13(spark, sf_dir):
    from lakesonar.llm.conversations import damaged, report
    rows = table(spark, sf_dir, "conversations")
    return report(damaged(rows), rows)


# 11 ------------------------------------------------------------------------

MINHASH_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT r, doc_id, list_sort(list_distinct([array_to_string(w[i:i + 3], ' ')
  FOR i IN range(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))])) AS s FROM d),
classes AS MATERIALIZED (SELECT row_number() OVER () AS c, s, len(s) AS n, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY s),
one AS MATERIALIZED (SELECT c, n, md5(unnest(s)) AS g FROM classes),
pairs AS (SELECT a.c AS x, b.c AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS shared
  FROM one a JOIN one b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.c, b.c),
links AS MATERIALIZED (SELECT x, y FROM pairs WHERE 100 * shared >= 80 * (nx + ny - shared)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, ways.y FROM reach JOIN ways ON reach.b = ways.x),
named AS (SELECT a AS c, min(k.least) AS component_id FROM reach JOIN classes k ON k.c = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id,
  coalesce(doc_id = CASE WHEN n IS NULL THEN doc_id ELSE component_id END, false) AS kept
FROM sets LEFT JOIN classes USING (s) LEFT JOIN named USING (c)"""


@query("op11_onepermutation_minhash", MINHASH_SQL)
def op11(spark, sf_dir):
    from lakesonar.llm.minhash import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.withColumn("kept", kept)
