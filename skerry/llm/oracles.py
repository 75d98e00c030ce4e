"""DuckDB SQL for those queries that SQL can express."""

OP1 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h)::BIGINT AS n, sha256(h) AS g FROM p
), f AS (
  SELECT g, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY g
)
SELECT d.page_id, d.n AS payload_bytes, d.g AS payload_digest,
  CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.g = f.g AND d.n >= 100
"""

OP2 = r"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules AS (
  SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) r(h, s, v)
), fits AS (
  SELECT page_id, url, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS v
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)
  GROUP BY page_id, url
), links AS (
  SELECT url, regexp_extract(html, '(?is)<link[^>]*rel="canonical"[^>]*href="([a-z]+://[^"]*)"', 1) AS target
  FROM p WHERE regexp_matches(html, '(?is)<link[^>]*rel="canonical"')
), edges AS (
  SELECT url AS a, target AS b FROM links WHERE target <> '' UNION SELECT target, url FROM links WHERE target <> ''
), reach(a, b) AS (
  SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), spread AS (
  SELECT r.a AS url, bool_or(f.v = 'block') AND NOT bool_or(f.v = 'allow') AS blocked
  FROM reach r JOIN fits f ON f.url = r.b GROUP BY r.a
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, CASE WHEN s.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits f ON f.page_id = p.page_id AND f.url = p.url LEFT JOIN spread s ON s.url = p.url
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source
), shares AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, total,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * langs.v) AS p, 1 + (1000000000::HUGEINT * (total + 2)) // (langs.n + 2 * langs.v) AS q
  FROM g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows
)
SELECT lang, source, part, item, value, rank FROM placed WHERE part = 'pair' OR rank <= 10
"""


def _levels(first: str, name: str, by: str, levels: int) -> str:
    """Tables name_0, name_1, ... of a tree's nodes from those of first: by, i, n, d and the siblings before (l) and after (r) in their runs; trees of one node stay."""
    run = f"(PARTITION BY {by}, i // 8 ORDER BY i ROWS BETWEEN"
    around = f"CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r"
    out = [f"{name}_0 AS (SELECT {by}, i, n, d, {around} FROM {first})"]
    for k in range(1, levels + 1):
        up = f"SELECT {by}, i // 8 AS i, (max(n) + 7) // 8 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE max(d) END AS d FROM {name}_{k - 1} GROUP BY {by}, i // 8"
        out.append(f"{name}_{k} AS (SELECT {by}, i, n, d, {around} FROM ({up}))")
    return ", ".join(out)


def _merkle(levels: int = 9, top_levels: int = 4) -> str:
    """SQL for trees of up to 8 ** levels rows a language and 8 ** top_levels languages."""
    cell = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(cell(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {cell(text)})"
    # CRC-32 of the decimal id, bit by bit: a table of 256 entries, then a fold over the digits
    crc = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda h, x: xor(h >> 8, crc_table[((xor(h, x) & 255) + 1)::BIGINT]))"
    bits = "list_reduce(list_prepend(b::UBIGINT, [0::UBIGINT for _ in range(8)]), lambda h, _: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384::UBIGINT) ELSE h >> 1 END)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [("a", k) for k in range(levels)] + [("b", k) for k in range(top_levels)]
    joins = " ".join([f"JOIN a_{k} ON a_{k}.tree = leaves.tree AND a_{k}.i = leaves.i // {8**k}" for k in range(levels)] + [f"JOIN b_{k} ON b_{k}.one = tops.one AND b_{k}.i = tops.i // {8**k}" for k in range(top_levels)])
    siblings = " || ".join(f"coalesce({t}_{k}.l || {t}_{k}.r, '')" for t, k in steps)
    folds = ["proofs AS (SELECT leaves.doc_id, leaves.d AS leaf, tops.d AS subroot, sha256(" + siblings + ") AS proof_sha256, leaves.present AS f0, " + ", ".join(f"{t}_{k}.l AS {t}l{k}, {t}_{k}.r AS {t}r{k}" for t, k in steps) + f" FROM leaves JOIN tops ON tops.tree = leaves.tree {joins})"]
    for j, (t, k) in enumerate(steps):
        folds.append(f"fold{j + 1} AS (SELECT * EXCLUDE (f0), CASE WHEN {t}l{k} IS NULL THEN f0 ELSE sha256({t}l{k} || f0 || {t}r{k}) END AS f0 FROM {'proofs' if j == 0 else f'fold{j}'})")
    return f"""
WITH t AS (
  SELECT list(c ORDER BY b) AS crc_table FROM (SELECT b, {bits} AS c FROM range(256) r(b))
), digests AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS d,
    CASE WHEN xor({crc}, 4294967295::UBIGINT) % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS present
  FROM documents, t
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM digests
), {_levels('leaves', 'a', 'tree', levels)}, tops AS (
  SELECT 1 AS one, tree, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM a_{levels}
), {_levels('tops', 'b', 'one', top_levels)}, {', '.join(folds)}
SELECT doc_id, leaf, subroot, b_{top_levels}.d AS root, proof_sha256, f0 AS folded_root, f0 = b_{top_levels}.d AS verified
FROM fold{len(steps)}, b_{top_levels}
"""


OP12 = _merkle()

ORACLES: dict[str, str] = {
    "op1_warc_seekable": OP1,
    "op2_redirect_equivalence": OP2,
    "op11_source_divergence": OP11,
    "op12_merkle_manifest": OP12,
}
