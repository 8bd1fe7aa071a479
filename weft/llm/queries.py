"""The registered queries of the operators in this folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontam, fingerprints, langid, lexical, licenses, mixing, negatives, packing, preference, simhash, toxicity, urlfilter, warc

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.swapped_replies(table(spark, sf_dir, "conversations"))
    got = preference.format_pairs(pairs, ["conv_id", "n_turns"])
    spans = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m["s"].cast("string"), F.lit("-"), m["e"].cast("string"))), ",")
    return got.select("conv_id", "n_turns", "n_common", "prompt", "chosen", spans("chosen_mask").alias("chosen_mask"), "rejected", spans("rejected_mask").alias("rejected_mask"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_language, op3_warc, op4_toxicity, op5_urlfilter, op6_decontamination, op7_packing, op8_simhash, op9_licenses, op10_preference, op11_lexical, op12_mixing, op13_negatives)}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _sketch(w: str) -> str:
    k, below, floor = fingerprints.SHINGLE, fingerprints.BELOW, fingerprints.FLOOR
    grams = f"CASE WHEN len({w}) >= {k} THEN list_transform(range(1, len({w}) - {k - 2}), lambda i: left(md5(array_to_string({w}[i:i + {k - 1}], ' ')), 16)) WHEN len({w}) > 0 THEN [left(md5(array_to_string({w}, ' ')), 16)] ELSE CAST([] AS VARCHAR[]) END"
    return f"list_filter(list_sort(list_distinct({grams})), lambda h, i: h < '{below}' OR i <= {floor})"


def _likeness(a: str, b: str) -> str:
    floor, last = fingerprints.FLOOR, format(int(fingerprints.BELOW, 16) - 1, "x") + "f" * 15
    known = lambda s: f"CASE WHEN len({s}) < {floor} THEN 'g' ELSE greatest({s}[-1], '{last}') END"
    limit = f"least({known(a)}, {known(b)})"
    x, y = (f"list_filter({s}, lambda h: h <= {limit})" for s in (a, b))
    of = f"least(len({x}), len({y}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN {of} = 0 THEN 0.0 ELSE CAST(len(list_intersect({x}, {y})) AS DOUBLE) / {of} END"


def _op1_sql() -> str:
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS nt FROM d),
    e AS (SELECT doc_id, text, nt, CAST(length(text) AS BIGINT) AS n_chars, left(text, length(text) - length(text) // 4) || left(nt, length(text) // 4) AS edited FROM n),
    w AS (SELECT *, {_WORDS.format(text='text')} AS w, {_WORDS.format(text='edited')} AS ew, {_WORDS.format(text='nt')} AS nw FROM e),
    s AS (SELECT *, {_sketch('w')} AS s, {_sketch('ew')} AS es, {_sketch('nw')} AS ns FROM w)
    SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(s, '') AS fingerprint, array_to_string(es, '') AS edited_fingerprint,
      {_likeness('s', 'es')} AS near_edited, {_likeness('s', 'ns')} AS near_next FROM s"""


def _op3_sql() -> str:
    digit = lambda p: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {p}) & 31 AS INTEGER) + 1, 1)"
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    g AS (SELECT h, max(page_id) AS top, count(*) AS n FROM p GROUP BY h),
    j AS (SELECT p.*, g.top, g.n FROM p JOIN g USING (h)),
    r AS (SELECT *, (n > 1 AND top IS NOT NULL AND (page_id IS NULL OR page_id <> top)) AS again FROM j)
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
      array_to_string(list_transform(list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)), lambda v: {' || '.join(digit(p) for p in (15, 10, 5, 0))}), '') AS payload_digest,
      CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM r"""


def _op6_sql() -> str:
    n = decontam.WINDOW
    return f"""
    WITH b0 AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(text='text')} AS w FROM benchmark),
    b1 AS (SELECT item_id, w, least(len(w), {n}) AS n FROM b0 WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM b1, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
    d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(text='text')} AS w FROM documents),
    pos AS (SELECT rid, k.n, i, array_to_string(w[i:i + k.n - 1], ' ') AS gram FROM d, (SELECT DISTINCT n FROM win) k, LATERAL (SELECT unnest(range(1, len(w) - k.n + 2)) AS i) WHERE len(w) >= k.n),
    hit AS (SELECT pos.rid, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.gram = win.gram AND pos.n = win.n),
    cov AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS x FROM hit) GROUP BY rid),
    items AS (SELECT rid, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN cov USING (rid) LEFT JOIN items USING (rid)"""


def _op9_sql() -> str:
    k, near, far = licenses.K, licenses.NEIGHBOUR, licenses.reach()
    rows = [f"({tid}, '{label}', {exact}, {len(w) - k + 1}, CAST({least} AS DOUBLE), {i}, '{' '.join(w[i:i + k])}')" for tid, label, exact, least, w in licenses.templates() for i in range(len(w) - k + 1)]
    return f"""
    WITH t(tid, label, exact, need, least, tpos, gram) AS (VALUES {', '.join(rows)}),
    d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(text='text')} AS w FROM documents),
    pos AS (SELECT rid, i - 1 AS pos, array_to_string(w[i:i + {k - 1}], ' ') AS gram FROM d, LATERAL (SELECT unnest(range(1, len(w) - {k - 2})) AS i)),
    hit AS (SELECT rid, tid, label, exact, need, least, pos, tpos, pos - tpos AS diag FROM pos JOIN t USING (gram)),
    off AS (SELECT unnest(range(-{near}, {near + 1})) AS o),
    merged AS (SELECT rid, tid, label, exact, need, least, diag + o AS anchor, count(DISTINCT tpos) AS votes, min(pos) AS first, max(pos) + {k - 1} AS last FROM hit JOIN off ON NOT exact OR o = 0 GROUP BY ALL),
    good AS (SELECT * FROM merged WHERE votes >= least * need),
    best AS (SELECT g.* FROM good g WHERE exact OR NOT EXISTS (SELECT 1 FROM good h WHERE h.rid = g.rid AND h.tid = g.tid AND abs(h.anchor - g.anchor) <= {2 * near} AND (h.votes, abs(g.last - g.first), -h.anchor) > (g.votes, abs(h.last - h.first), -g.anchor))),
    span AS (SELECT x.*, CAST(votes AS DOUBLE) / need AS cover FROM best x),
    kept AS (SELECT * FROM span x WHERE exact OR NOT EXISTS (SELECT 1 FROM span y WHERE y.rid = x.rid AND NOT y.exact AND y.label <> x.label AND y.cover > x.cover AND y.first <= x.last AND y.last >= x.first AND abs(y.first - x.first) <= {far})),
    per AS (SELECT rid, count(*) FILTER (exact) AS n_base, min(first) FILTER (exact) AS first_word, max(first) FILTER (exact) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM kept GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0.0) AS DOUBLE) AS score FROM d LEFT JOIN per USING (rid)"""


def _op10_sql() -> str:
    s, e = preference.START, preference.END
    text = lambda t: f"'{s}' || {t}.role || chr(10) || {t}.text || '{e}' || chr(10)"
    size = lambda t: f"({len(s) + len(e) + 2} + length({t}.role) + length({t}.text))"
    render = lambda ts: f"array_to_string(list_transform({ts}, lambda t: {text('t')}), '')"
    # start of turn i in its completion: the sizes of those before it
    start = lambda ts: f"coalesce(list_sum(list_transform({ts}[1:i - 1], lambda u: {size('u')})), 0)"
    masks = lambda ts: f"array_to_string(list_transform(list_filter(range(1, len({ts}) + 1), lambda i: {ts}[i].role = 'assistant'), lambda i: CAST(CAST({start(ts)} + {len(s) + 1} + length({ts}[i].role) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST({start(ts)} + {size(f'{ts}[i]')} - 1 AS BIGINT) AS VARCHAR)), ',')"
    return f"""
    WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id),
    a AS (SELECT *, coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')), 0) AS la FROM c),
    r AS (SELECT *, CASE WHEN la > 0 THEN turns[la].text END AS reply FROM a),
    x AS (SELECT *, CASE WHEN lead(conv_id) OVER (ORDER BY conv_id) IS NULL THEN first_value(reply) OVER (ORDER BY conv_id) ELSE lead(reply) OVER (ORDER BY conv_id) END AS nr FROM r),
    p AS (SELECT conv_id, turns, la, CASE WHEN la = 0 THEN turns WHEN nr IS NULL THEN turns[1:la - 1] || turns[la + 1:] ELSE turns[1:la - 1] || [{{'role': 'assistant', 'text': nr}}] || turns[la + 1:] END AS other FROM x),
    n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(turns), len(other)) + 1), lambda i: turns[i] <> other[i])) - 1, least(len(turns), len(other))) AS k FROM p),
    q AS (SELECT *, turns[1:k] AS common, turns[k + 1:] AS ct, other[k + 1:] AS rt FROM n)
    SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, CAST(k AS BIGINT) AS n_common, {render('common')} AS prompt, {render('ct')} AS chosen, {masks('ct')} AS chosen_mask, {render('rt')} AS rejected, {masks('rt')} AS rejected_mask FROM q"""


def _op11_sql() -> str:
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(text='text')} AS w FROM documents),
    c AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
    t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
    i AS (SELECT row_number() OVER () AS item, item_id, {_WORDS.format(text='text')} AS w FROM benchmark),
    q AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(w) AS term FROM i) GROUP BY ALL),
    f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS wt FROM t, c GROUP BY term, nn),
    m AS (SELECT rid, doc_id, 100 - 25 + ((25 * len(w) * nn) // ll) AS m FROM d, c WHERE len(w) > 0),
    s AS (SELECT item, rid, sum(times * wt * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS score, any_value(doc_id) AS doc_id FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (rid) GROUP BY item, rid),
    r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM s WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r JOIN i USING (item) WHERE rank <= {lexical.TOP}"""


def _op12_sql() -> str:
    share, most = mixing.SHARE, mixing.MOST
    weight = f"[{', '.join(map(str, mixing.WEIGHTS))}][place % {len(mixing.WEIGHTS)} + 1]"
    return f"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) / 281474976710656.0 AS draw FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
    w AS (SELECT source, s, place, CAST({weight} AS BIGINT) AS w FROM s),
    p AS (SELECT *, {share} * CAST(sum(s) OVER () AS HUGEINT) AS whole, CAST(coalesce(sum(s) OVER before, 0) AS HUGEINT) AS taken, CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS HUGEINT) AS rest
      FROM w WINDOW before AS (ORDER BY s / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, {100 * most} * CAST(s AS HUGEINT) * rest <= w * (whole - {100 * most} * taken) AS capped FROM p),
    o AS (SELECT any_value(whole) - {100 * most} * coalesce(sum(s) FILTER (capped), 0) AS open, coalesce(sum(w) FILTER (NOT capped), 0) AS ow FROM l),
    t AS (SELECT source, s, CASE WHEN ow = 0 THEN CAST({most} * s AS DOUBLE) ELSE least(CAST({most} * s AS DOUBLE), CAST(open AS DOUBLE) * w / CAST(100 * ow AS DOUBLE)) END AS target FROM l, o),
    r AS (SELECT doc_id, size, s, target, draw, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, s AS source_size, target, size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM r"""


def _op13_sql() -> str:
    p, n = negatives.POSITIVES, negatives.NEGATIVES
    return f"""
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) AS k FROM s WHERE same),
    n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id NULLS LAST, s.b) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.k <= {p})
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {n}"""


ORACLE_SQL = {"op1_fingerprints": _op1_sql(), "op3_warc": _op3_sql(), "op6_decontamination": _op6_sql(), "op9_licenses": _op9_sql(), "op10_preference": _op10_sql(), "op11_lexical": _op11_sql(), "op12_mixing": _op12_sql(), "op13_negatives": _op13_sql()}
