"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, contamination, fingerprints, hosts, licenses, ngrams, packing, quality, running, runs, simhash, substrings, toxicity, trie
from .catalog import query, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path(TOKENIZER))


@query("op5_packing")
def q_packing(spark, sf_dir):
    """Pieces of all documents with their sequence and offset."""
    pieces = packing.encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op2_simhash")
def q_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of all documents: three words, three bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=3)


SUBSTRINGS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) t(i)),
f AS (SELECT k, min((doc_id, i)) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT win.doc_id, win.i + j.range AS p FROM win JOIN f USING (k), range(0, 20) j WHERE (win.doc_id, win.i) <> f.first),
kept AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS text, count(*) AS n
         FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) u
         ANTI JOIN gone USING (doc_id, p) GROUP BY u.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


@query("op4_substrings", sql=SUBSTRINGS_SQL)
def q_substrings(spark, sf_dir):
    """Words of all documents kept when windows of twenty words that start earlier go."""
    out = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), size=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_ALNUM_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
DECONTAMINATION_SQL = f"""
WITH iw AS (SELECT item_id, {_ALNUM_SQL} AS ws FROM benchmark),
ik AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
       FROM iw, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i) WHERE len(ws) > 0),
dw AS (SELECT doc_id, {_ALNUM_SQL} AS ws FROM documents),
dk AS (SELECT doc_id, i, s.n, array_to_string(ws[i:i + s.n - 1], ' ') AS k
       FROM dw, (SELECT DISTINCT n FROM ik) s, unnest(range(1, len(ws) - s.n + 2)) t(i)),
m AS (SELECT dk.doc_id, dk.i, dk.n, ik.item_id FROM dk JOIN ik USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT m.i + j.range) AS n_hit FROM m, range(0, 10) j WHERE j.range < m.n GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) d GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query("op7_decontamination", sql=DECONTAMINATION_SQL)
def q_decontamination(spark, sf_dir):
    """Words of all documents inside an occurrence of ten consecutive words of a benchmark item."""
    out = contamination.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op1_language_model")
def q_language_model(spark, sf_dir):
    """Scores of all documents by a model of nine tenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngrams.train(docs.where(ngrams.fold(10) != 0))
    return ngrams.score(docs, model).select(
        "doc_id", (ngrams.fold(10) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op6_toxicity")
def q_toxicity(spark, sf_dir):
    """Toxicity of all documents, learned from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, toxicity.learning_rows(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, net).select(
        "doc_id", (toxicity.crc_fold(3) == 1).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.AT).cast("int").alias("predicted"))


@query("op8_quality")
def q_quality(spark, sf_dir):
    """Quality of all documents, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(toxicity.crc_fold(5) != 0))
    return quality.score(docs, model).select(
        "doc_id", (toxicity.crc_fold(5) == 0).alias("held_out"), F.col("quality").alias("score"),
        (F.col("quality") >= quality.AT).cast("int").alias("predicted"))


@query("op9_licenses")
def q_licenses(spark, sf_dir):
    """License phrases and templates in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _level_sql(name: str, by: str, above: str | None) -> str:
    """Prior means and strength of a level from the one above, as ``hosts.reputation`` has them."""
    key = f"{by}, {above}" if above else by
    parent = f"JOIN {above}_level a USING ({above}), {above}_s s" if above else \
        "JOIN (SELECT sum(n) AS n, sum(bad) AS bad, 0.5::DOUBLE AS mean FROM h) a ON true, (SELECT 2.0::DOUBLE AS s) s"
    return f"""{name}_level AS (
  SELECT o.*, (a.bad - o.bad + s.s * a.mean) / (a.n - o.n + s.s) AS mean
  FROM (SELECT {key}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM h GROUP BY {key}) o {parent}),
{name}_s AS (
  SELECT CASE WHEN coalesce(scale, 0) = 0 THEN 10.0::DOUBLE ELSE least(greatest(
           greatest(scale - chance, 1e-9) / greatest(spread - chance, 1e-9) - 1, 0.5), 1e4) END AS s
  FROM (SELECT sum(n * pow(bad / n - mean, 2)) AS spread, sum(mean * (1 - mean)) AS chance, sum(n * mean * (1 - mean)) AS scale
        FROM {name}_level WHERE n > 0))"""


_LONG = ", ".join(f"'{s}'" for s in hosts.LONG_SUFFIXES)
_Z2 = hosts.BOUND ** 2
URLS_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{hosts.UPPER}', '{hosts.LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(v, rh, rp) AS (VALUES {", ".join(f"('{x.verdict}', '{x.host}', '{x.path}')" for x in hosts.RULES)}),
best AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
         FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
j AS (SELECT p.*, rule, v FROM p LEFT JOIN best USING (page_id)),
h0 AS (SELECT host, count(v) AS n, count(*) FILTER (v = 'block') AS bad, string_split(host, '.') AS l FROM j GROUP BY host),
h AS (SELECT host, n, bad, CASE WHEN array_to_string(l[-2:], '.') IN ({_LONG}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
             CASE WHEN array_to_string(l[-2:], '.') IN ({_LONG}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM h0),
{_level_sql("suffix", "suffix", None)},
{_level_sql("domain", "domain", "suffix")},
{_level_sql("host", "host", "domain")},
post AS (SELECT host, (bad + s * mean) / (n + s) AS rate, n + s AS w FROM host_level, host_s),
low AS (SELECT host, rate, (rate + {_Z2} / (2 * w) - {hosts.BOUND} * sqrt(rate * (1 - rate) / w + {_Z2} / (4 * w * w))) / (1 + {_Z2} / w) AS low FROM post)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN low > {hosts.COST / (1 + hosts.COST)} THEN 'block' ELSE 'allow' END) AS verdict,
       round(rate, 6) AS rate, round(greatest(low, 0), 6) + 0.0 AS low
FROM j JOIN low USING (host)"""


@query("op10_urls", sql=URLS_SQL)
def q_urls(spark, sf_dir):
    """Verdict on all pages by rule, else by the reputation of the host."""
    return hosts.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", F.round("rate", 6).alias("rate"), (F.round("low", 6) + 0.0).alias("low"))


@query("op3_fingerprints")
def q_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, with the class and the number of links within three bits."""
    prints = fingerprints.compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return fingerprints.with_neighbours(prints, radius=3).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "has_near",
        "n_links", "class")


#: Start and polynomial of CRC-32.
_CRC_TABLE_SQL = """(SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def _crc_sql(number: str) -> str:
    """CRC-32 of a number in decimal, with the table ``t`` of ``_CRC_TABLE_SQL``."""
    octets = f"list_transform(string_split({number}::VARCHAR, ''), lambda o: ord(o)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1])), 4294967295)"


RUNS_SQL = rf"""
WITH d0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_crc_sql("doc_id")} AS h
            FROM documents, {_CRC_TABLE_SQL}),
d1 AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d0),
d2 AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM d1),
d AS (SELECT row_number() OVER () AS k, doc_id, n, CASE WHEN a IS NULL THEN ws
        ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) END AS ws FROM d2),
w AS (SELECT k, n, unnest(ws) AS word, unnest(range(0, n)) AS i FROM d),
m AS (SELECT x.k, x.i, y.i - x.i AS p FROM w x JOIN w y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
g AS (SELECT k, p, i, i - row_number() OVER (PARTITION BY k, p ORDER BY i) AS island FROM m),
r0 AS (SELECT k, p, min(i) AS start, count(*) + p AS length FROM g GROUP BY k, p, island HAVING count(*) >= greatest(p, 12 - p)),
r AS (SELECT k, start, length, min(p) AS period FROM r0 GROUP BY k, start, length),
best AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
                arg_min((start, length, period), (-length, start, period)) AS b FROM r GROUP BY k),
gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b[1]::BIGINT AS start, b[2]::BIGINT AS length, b[3]::BIGINT AS period,
       (1000 * b[2] // b[3])::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
       sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (k) LEFT JOIN kept USING (k)"""


def _periodic_tail(docs):
    """Texts of one document in ten (by crc32 of the id) with their last words made periodic, as the contract has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, ws = F.expr("h div 10"), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size("ws")
    tail = F.expr("transform(ws, (w, i) -> if(i < a, w, ws[cast(a + (i - a) % p as int)]))")
    hit = docs.withColumn("h", h).withColumn("ws", F.when(F.col("h") % 10 == 0, ws))
    hit = hit.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.when(n > 0, 1 + F.expr("(size(ws) - a) div (3 + (h div 10) % 8)")))
    return hit.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_runs", sql=RUNS_SQL)
def q_runs(spark, sf_dir):
    """Periodic runs of all documents, one in ten with a periodic tail, and digests of what is left without them."""
    out = runs.annotate(_periodic_tail(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.withColumn("best", best).withColumn("lines", lines).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        sha("lines").alias("runs_sha256"), sha("collapsed").alias("collapsed_sha256"))


@query("op13_chat")
def q_chat(spark, sf_dir):
    """All conversations and one full of marks, formatted in windows and read back."""
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit("</s>[INST] ok [/INST]").alias("text"))
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat.read_back(chat.format_windows(talks))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return back.select("conv_id", "n_turns", sha("turns").alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
                       sha("loss_text").alias("loss_sha256"), "formatted_chars")


TRIE_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc_sql("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), {_CRC_TABLE_SQL}),
rebuilt AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos < h
            UNION ALL SELECT conv_id, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
path0 AS (SELECT conv_id, text, row_number() OVER w AS depth, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS said
          FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
path AS (SELECT conv_id, depth, sha256(said) AS k, length(text) AS chars FROM path0 UNION ALL SELECT conv_id, 0, '', 0 FROM c),
node AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM path GROUP BY k, depth),
up AS (SELECT DISTINCT a.k, b.k AS parent FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.depth = a.depth - 1),
children AS (SELECT parent AS k, count(*) AS n FROM up GROUP BY parent),
pairs AS (SELECT DISTINCT b.k AS k, a.k AS sub FROM path a JOIN path b ON a.conv_id = b.conv_id AND a.depth >= b.depth),
sums AS (SELECT pairs.k, count(*) FILTER (children.n IS NULL) AS n_leaves, sum((node.n - 1) * node.chars) AS saved
         FROM pairs JOIN node ON node.k = sub LEFT JOIN children ON children.k = sub GROUP BY pairs.k),
ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
         FROM (SELECT conv_id, arg_max(k, depth) AS k FROM path GROUP BY conv_id) e GROUP BY k)
SELECT node.conv_id, node.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, node.n::BIGINT AS n_convs, coalesce(children.n, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN sums USING (k) LEFT JOIN children USING (k) LEFT JOIN ends USING (k) LEFT JOIN up USING (k) LEFT JOIN node p ON p.k = up.parent"""


def rebuilt(talks):
    """(ids, turns) of the conversations as the contract rebuilds them from their hundred's first and their own turns.

    Turns stand in the order of ``turn`` (null first; ties by role, then text); rows without an id are in no conversation.
    """
    said = talks.where("conv_id is not null").select(
        "conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    turns = running.ordered(said, "conv_id", [F.col("turn"), F.col("role"), F.col("text")], {}, "conversations").drop("turn")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    heads = turns.where("conv_id % 100 = 0 and pos < 5").groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("heads"))
    ids = turns.select("conv_id").distinct()
    none = F.expr("cast(array() as array<struct<pos:bigint,role:string,text:string>>)")
    taken = ids.withColumn("base", F.expr("conv_id - conv_id % 100")).join(heads, "base", "left").select(
        "conv_id", h.alias("h"), F.coalesce(F.slice("heads", F.lit(1), h.cast("int")), none).alias("heads"))
    first = taken.select("conv_id", F.posexplode("heads")).select("conv_id", F.col("pos").alias("place"), "col.role", "col.text")
    own = turns.where(F.col("pos") >= h).join(taken.select("conv_id", "h", F.size("heads").alias("m")), "conv_id").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("place"), "role", "text")
    return ids, first.withColumn("place", F.col("place").cast("bigint")).unionByName(own)


@query("op11_trie", sql=TRIE_SQL)
def q_trie(spark, sf_dir):
    """Nodes of the prefix trie of all rebuilt conversations."""
    return trie.build(*rebuilt(table(spark, sf_dir, "conversations")))
