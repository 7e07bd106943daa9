"""The registered queries of the training-data operators, with their DuckDB equivalents where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.licences import licence_scan

    return licence_scan(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.secret_scan import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents"))


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: The split and extract lists are zipped; each match's end is a running sum of gap and match lengths.
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
rules(kind, rank, least, grp) AS (VALUES ('assign', 0, 6, 2), ('access', 1, 20, 0), ('hex', 2, 24, 0)),
m AS (
  SELECT rn, 'assign' AS kind, regexp_extract_all(text, '{_ASSIGN}') AS found, string_split_regex(text, '{_ASSIGN}') AS gaps FROM d
  UNION ALL SELECT rn, 'access', regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rn, 'hex', regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') FROM d),
x AS (SELECT rn, kind, unnest(found) AS hit, unnest(gaps[1:len(found)]) AS gap, unnest(range(len(found))) AS nth FROM m),
p AS (SELECT rn, kind, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY rn, kind ORDER BY nth) AS e FROM x),
f AS (
  SELECT rn, kind, rank, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM p JOIN rules USING (kind)
  WHERE CASE WHEN grp = 2 THEN length(regexp_extract(hit, '{_ASSIGN}', 2)) ELSE length(hit) END >= least),
a AS (
  SELECT rn, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM f GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rn)
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.substring_dedup import repeats

    return repeats(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _op10_sql() -> str:
    from gridloom.llm import decontaminate as d

    said = lambda x: "'" + x.replace("'", "''") + "'"
    replaced = lambda e, pattern, by: f"regexp_replace({e}, {said(pattern)}, {said(by)}, 'g')" if d.is_pattern(pattern) else f"replace({e}, {said(pattern)}, {said(by)})"
    parted = f"translate(coalesce(text, ''), {said(d.POINT + d.WORD + d.BREAK)}, '   ')"
    for pattern, by in d.PARTED:
        parted = replaced(parted, pattern, by)
    parted = f"ltrim({parted}, {said(f' {d.START}')})"

    def slotted(reading: str) -> str:
        apart = f"replace(parts, {said(d.START)}, {said(d.START + ' ')})"
        out = replaced(f"' ' || {replaced(apart, *d.DIGITS)} || ' '", " +", "  ")
        for pattern, by in d.NUMBERED:
            out = replaced(out, pattern, by)
        if reading == "words":
            out = f"replace({out}, {said(d.START + '  ')}, {said(d.START + '  ' + d.WORD)})"
        elif reading == "first":
            out = f"({said(d.OPENED + d.WORD)} || substr({out}, {len(d.OPENED) + 1}))"
        for pattern, by in d.NAMED:
            out = replaced(out, pattern, by)
        return f"translate(lower({out}), {said(d.WORD + d.BREAK)}, '')"

    canonical = lambda e: f"string_split_regex(trim({replaced(e, *d.EMPTIED)}), ' +')"
    tokens = lambda e, pattern: f"regexp_extract_all({e}, {said(pattern)})"
    opening = lambda e: f"{e} IN ({', '.join(map(said, d.OPENINGS))})"
    plainly = lambda e: f"list_transform({e}, lambda w: replace(w, {said(d.START)}, ''))"
    literal = lambda start, size: f"len(list_filter(words[{start}:{start} + {size} - 1], lambda w: NOT ({opening('w')})))"
    held = lambda e: f"list_filter({e}, lambda v: {opening('v[1:1]')})"
    slots = lambda e: f"list_transform({held(e)}, lambda v: list_position({held(e)}, v))"
    side = lambda name, key, table, readings: f"""
    {name}_p AS (SELECT row_number() OVER () AS rn, {key} AS id, {said(d.START)} || {parted} AS parts FROM {table}),
    {name}_s AS (SELECT *, unnest([{", ".join(map(slotted, readings))}]) AS s FROM {name}_p),
    {name}_m AS (SELECT *, replace(s, {said(d.START)}, '') AS m FROM {name}_s),
    {name} AS (SELECT rn, id, parts, s, {tokens("lower(parts)", d.PLAIN)} AS plain, {tokens("m", d.TOKEN)} AS tokens, {canonical("m")} AS words FROM {name}_m),
    {name}_c AS (SELECT *, {canonical("clause")} AS held, {tokens("clause", d.TOKEN)} AS held_tokens FROM (SELECT *, unnest(string_split(s, {said(d.START)})) AS clause, unnest(range(len(string_split(s, {said(d.START)})))) AS nth FROM {name}))"""  # noqa: E731
    longer = " ".join(
        f"WHEN least(n, {times * d.WINDOW}) > length AND {literal(start, f'least(n, {times * d.WINDOW})')} >= {d.LITERALS} THEN {{'start': {start}, 'size': least(n, {times * d.WINDOW})}}"
        for times in (2, 4)
        for start in [f"least(pos, n - least(n, {times * d.WINDOW}) + 1)"]
    )
    return f"""
    WITH {side("d", "doc_id", "documents", d.READINGS[:1])},
    {side("b", "item_id", "benchmark", d.READINGS)},
    bn AS (SELECT *, len(words) AS n, least(len(words), {d.WINDOW}) AS length FROM b WHERE len(plain) > 0),
    bp AS (SELECT *, unnest(CASE WHEN n >= {d.SHORTEST} THEN range(1, n - length + 2) ELSE [NULL::BIGINT] END) AS pos FROM bn),
    ba AS (SELECT *, pos IS NULL OR {literal("pos", "length")} < least(length, {d.LITERALS}) AS few FROM bp),
    bf AS (SELECT * FROM ba WHERE NOT few OR NOT EXISTS (SELECT 1 FROM ba r WHERE r.rn = ba.rn AND r.s = ba.s AND NOT r.few AND abs(r.pos - ba.pos) <= {d.WINDOW // 2})),
    bs AS (SELECT *, CASE WHEN NOT few THEN {{'start': pos, 'size': length}} WHEN pos IS NULL THEN NULL {longer} END AS shape FROM bf),
    bx AS (SELECT DISTINCT id, parts, plain, least(len(plain), {d.WINDOW}) AS length FROM bs WHERE few),
    bw AS (
      SELECT DISTINCT id, pos, shape['size'] AS length, false AS exact, false AS whole, words[shape['start']:shape['start'] + shape['size'] - 1] AS words,
             {slots("tokens[shape['start']:shape['start'] + shape['size'] - 1]")} AS slots FROM bs WHERE shape IS NOT NULL
      UNION
      SELECT id, pos, length, true, len(plain) < {d.SHORTEST} AND NOT regexp_matches(parts, {said(d.UNSPACED)}), {plainly("plain[pos:pos + length - 1]")}, []
      FROM (SELECT *, unnest(range(1, len(plain) - length + 2)) AS pos FROM bx)),
    bc AS (
      SELECT DISTINCT b_c.id, -nth AS pos, held AS words, {slots("held_tokens")} AS slots FROM b_c
      WHERE s IN (SELECT s FROM bs WHERE few AND shape IS NULL AND bs.id IS NOT DISTINCT FROM b_c.id) AND len(held) >= {d.SHORTEST} AND len(list_filter(held, lambda w: NOT ({opening("w")}))) > 0),
    dc AS (SELECT DISTINCT id, held AS words, {slots("held_tokens")} AS slots FROM d_c WHERE len(held) >= {d.SHORTEST}),
    dk AS (SELECT d.*, exact, length, CASE WHEN exact THEN plain ELSE words END AS held FROM d, (SELECT DISTINCT exact, length FROM bw)),
    dp AS (SELECT *, unnest(range(1, len(held) - length + 2)) AS pos FROM dk WHERE len(held) >= length),
    dw AS (
      SELECT DISTINCT id, exact, CASE WHEN exact THEN {plainly("held[pos:pos + length - 1]")} ELSE held[pos:pos + length - 1] END AS words,
             CASE WHEN exact THEN [] ELSE {slots("tokens[pos:pos + length - 1]")} END AS slots,
             exact AND length < {d.SHORTEST} AND starts_with(held[pos], {said(d.START)}) AND (pos + length > len(held) OR starts_with(held[pos + length], {said(d.START)})) AS is_whole
      FROM dp),
    f AS (
      SELECT DISTINCT dw.id AS doc_id, bw.id AS item_id, bw.pos, bw.exact FROM dw JOIN bw ON dw.exact = bw.exact AND dw.words = bw.words AND dw.slots = bw.slots WHERE NOT whole OR is_whole
      UNION SELECT dc.id, bc.id, bc.pos, false FROM dc JOIN bc ON dc.words = bc.words AND dc.slots = bc.slots),
    t AS (
      SELECT id AS item_id, count(*) FILTER (pos > 0) AS total, count(*) FILTER (pos < 0) AS clauses
      FROM (SELECT DISTINCT id, pos, exact FROM bw UNION SELECT id, pos, false FROM bc) GROUP BY 1)
    SELECT doc_id, f.item_id, count(*) AS n_windows, greatest(count(*) FILTER (pos > 0) / nullif(max(total), 0), count(*) FILTER (pos < 0) / nullif(max(clauses), 0)) AS coverage
    FROM f JOIN t ON f.item_id IS NOT DISTINCT FROM t.item_id GROUP BY 1, 2
    """


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.language import language_id

    return language_id(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


_QUINT = "CAST('0x' || hexed[g * 5 + 1:g * 5 + 5] AS INTEGER)"
_LETTERS = " || ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(({_QUINT} >> {s}) & 31) + 1]" for s in (15, 10, 5, 0))
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hexed FROM pages),
w AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, hexed, max(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(8), lambda g: {_LETTERS}), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM w
"""

def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))

def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.chat import chat_formatting

    return chat_formatting(_table(spark, sf_dir, "conversations"))


def _op11_sql() -> str:
    """What reading back must give, from the table alone; the machine as a walk over the turns."""
    from gridloom.llm.chat import PROBE, PROBE_ID, Template

    t = Template()
    said = lambda x: "'" + x.replace("'", "''") + "'"
    escaped = "text"
    for first, rest in t.patterns():
        escaped = f"regexp_replace({escaped}, {said(rf'({first})(\\*{rest})')}, '\\1\\\\\\2', 'g')"
    moves = ", ".join(f"({said(a)}, {said(role)}, {said(b)})" for a, takes in t.turns.items() for role, b in takes.items())
    marks = sum(map(len, (t.opening, t.between, t.closing)))
    return f"""
    WITH RECURSIVE c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT {PROBE_ID}, unnest([0, 1]), unnest(['user', 'assistant']), {said(PROBE)}),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM c),
    moves(a, role, b) AS (VALUES {moves}),
    w AS (
      SELECT o.conv_id, nth, b AS state, CASE WHEN b IS NULL THEN nth END AS bad FROM o LEFT JOIN moves m ON m.a = {said(t.start)} AND m.role = o.role WHERE nth = 1
      UNION ALL
      SELECT o.conv_id, o.nth, m.b, coalesce(w.bad, CASE WHEN m.b IS NULL THEN o.nth END)
      FROM w JOIN o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.nth = w.nth + 1 LEFT JOIN moves m ON m.a = w.state AND m.role = o.role),
    e AS (SELECT conv_id, arg_max(state, nth) AS state, arg_max(bad, nth) FILTER (bad IS NOT NULL) AS bad FROM w GROUP BY 1),
    d AS (
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY nth) FILTER (role IN ({", ".join(map(said, t.learnt))})), '') AS learnt,
             CAST(sum(length(role) + length({escaped}) + {marks}) AS BIGINT) AS formatted_chars
      FROM o GROUP BY 1)
    SELECT d.conv_id, n_turns, turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars,
           bad IS NULL AND coalesce(state, '') IN ({", ".join(map(said, t.ends))}) AS valid, CAST(bad - 1 AS INT) AS bad_turn
    FROM d JOIN e ON d.conv_id IS NOT DISTINCT FROM e.conv_id
    """

def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.merkle import tampered_manifest

    return tampered_manifest(_table(spark, sf_dir, "documents"))


def _op12_sql() -> str:
    """Levels by recursion, siblings from the levels, and the tampered leaf folded up level by level."""
    said = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(said, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    # The lowest bit of a checksum, digit by digit, by recursion: DuckDB has no crc32 of its own.
    step = "xor(r, CAST(ascii(said[k + 1]) AS UBIGINT))"
    for _ in range(8):
        step = f"list_transform([{step}], lambda v: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS UBIGINT)) ELSE v // 2 END)[1]"
    levels = lambda of: f"SELECT level + 1, tree, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {of} WHERE n > 1 GROUP BY level, tree, i // 3, n"
    beside = lambda leaves, nodes: f"""
      SELECT l.rn, v.level, coalesce(string_agg(v.h, '' ORDER BY v.i) FILTER (v.i < l.i // CAST(pow(3, v.level) AS BIGINT)), '') AS lefts,
             coalesce(string_agg(v.h, '' ORDER BY v.i) FILTER (v.i > l.i // CAST(pow(3, v.level) AS BIGINT)), '') AS rights
      FROM {leaves} l JOIN {nodes} v ON v.tree = l.tree AND v.n > 1 AND v.i // 3 = l.i // CAST(pow(3, v.level + 1) AS BIGINT) GROUP BY 1, 2"""  # noqa: E731
    return f"""
    WITH RECURSIVE d AS (
      SELECT *, row_number() OVER () AS rn, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, CAST(doc_id AS VARCHAR) AS said, {leaf("text")} AS leaf, {leaf("replace(text, chr(10), '')")} AS less FROM documents),
    crc AS (SELECT rn, said, 0 AS k, CAST(4294967295 AS UBIGINT) AS r FROM d WHERE said IS NOT NULL UNION ALL SELECT rn, said, k + 1, {step} FROM crc WHERE k < length(said)),
    hit AS (SELECT rn, xor(r, CAST(4294967295 AS UBIGINT)) % 2 = 0 AS hit FROM crc WHERE k = length(said)),
    l AS (SELECT rn, tree, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
    v(level, tree, i, n, h) AS (SELECT 0, tree, i, n, h FROM l UNION ALL {levels("v")}),
    s AS (SELECT tree AS name, h AS subroot, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM v WHERE n = 1),
    sl AS (SELECT name AS rn, tree, i, n, subroot AS h FROM s),
    t(level, tree, i, n, h) AS (SELECT 0, tree, i, n, subroot FROM s UNION ALL {levels("t")}),
    b1 AS ({beside("l", "v")}), b2 AS ({beside("sl", "t")}),
    steps AS (SELECT rn, 0 AS part, level, lefts, rights FROM b1 UNION ALL SELECT d.rn, 1, level, lefts, rights FROM d JOIN b2 ON b2.rn = d.tree),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY part, level) AS k, count(*) OVER (PARTITION BY rn) AS many FROM steps),
    f(rn, k, h) AS (
      SELECT d.rn, 0, CASE WHEN hit THEN less ELSE leaf END FROM d LEFT JOIN hit USING (rn)
      UNION ALL SELECT f.rn, o.k, sha256(lefts || f.h || rights) FROM f JOIN ordered o ON o.rn = f.rn AND o.k = f.k + 1),
    p AS (SELECT rn, sha256(string_agg(lefts || rights, '' ORDER BY k)) AS proof_sha256 FROM ordered GROUP BY rn)
    SELECT doc_id, leaf, subroot, t.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
    FROM d JOIN s ON s.name = d.tree JOIN t ON t.n = 1 LEFT JOIN p USING (rn) JOIN f ON f.rn = d.rn AND f.k = coalesce((SELECT max(many) FROM ordered o WHERE o.rn = d.rn), 0)
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_licence_scan": op3_licence_scan,
    "op4_simhash": op4_simhash,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_merkle_manifest": op12_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op5_secret_scan": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op10_decontaminate": _op10_sql(),
    "op11_chat_formatting": _op11_sql(),
    "op12_merkle_manifest": _op12_sql(),
}
