"""DuckDB texts for the operators that SQL can express, by the contract's plain definitions."""

from herdwatch.llm import manifest, warc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM {{documents}}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {ALNUM_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS p
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) AS t(i) WHERE len(w) > 0),
occ AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS p
  FROM d, (SELECT DISTINCT m FROM win) AS ms, unnest(generate_series(1, len(w) - m + 1)) AS t(i)),
found AS (SELECT DISTINCT doc_id, item_id, i, occ.m FROM occ JOIN win ON occ.p = win.p AND occ.m = win.m),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM found, unnest(generate_series(0, m - 1)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACED_WORDS} AS w FROM {{documents}}),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
       FROM d, unnest(generate_series(1, greatest(1, len(w) - 3))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

WARC = f"""
WITH cap AS ({warc.CAPTURES.format(pages="pages")}),
u AS (SELECT *, lpad(CAST(page_id AS VARCHAR), 12, '0') || '-' || CAST(visit AS VARCHAR) AS record_id,
             regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM cap),
p AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[.]', '') AS host,
             regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'),
               lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|sessionid|jsessionid|sid|phpsessid)(=|$)'))) AS q FROM u),
r AS (SELECT *, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM p),
w AS (SELECT *, max(CASE WHEN record_type = 'response' THEN lpad(CAST(seconds AS VARCHAR), 15, '0') || record_id END)
             OVER (PARTITION BY canonical_url ORDER BY seconds, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM r),
j AS (SELECT w.*, o.record_id AS old_id, o.etag AS old_etag, o.modified AS old_modified, o.cache AS old_cache, o.html AS old_html
      FROM w LEFT JOIN r o ON w.record_type = 'revisit' AND o.record_type = 'response' AND o.record_id = substr(w.latest, 16)),
s AS (SELECT *, CASE WHEN record_type = 'response' THEN 'response' WHEN old_id IS NULL THEN 'no-response'
       WHEN etag IS NOT NULL AND old_etag IS NOT NULL
       THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(old_etag, '^W/', '') THEN 'etag' ELSE 'mismatch' END
       WHEN modified IS NOT NULL AND old_modified IS NOT NULL THEN CASE WHEN modified = old_modified THEN 'last-modified' ELSE 'mismatch' END
       ELSE 'unvalidated' END AS status FROM j)
SELECT record_id, record_type, canonical_url, seconds, status,
  CASE WHEN status = 'response' THEN record_id WHEN status IN ('etag', 'last-modified', 'unvalidated') THEN old_id END AS refers_to,
  CASE WHEN status = 'response'
       THEN concat_ws(';', 'cache-control=' || cache, 'content-type=text/html', 'etag=' || etag, 'last-modified=' || modified)
       WHEN status IN ('etag', 'last-modified', 'unvalidated')
       THEN concat_ws(';', 'cache-control=' || coalesce(cache, old_cache), 'content-type=text/html', 'etag=' || coalesce(etag, old_etag),
                      'last-modified=' || coalesce(modified, old_modified)) END AS headers,
  CASE WHEN status = 'response' THEN sha256(html) WHEN status IN ('etag', 'last-modified', 'unvalidated') THEN sha256(old_html) END AS payload_digest
FROM s
"""

ENCODED = "coalesce(strlen({0}) || ':' || {0}, '-')"
TAMPERED = f"translate(text, '{UPPER}', '{LOWER}')"
LEAF = "sha256(" + " || ".join(ENCODED.format(f"CAST({c} AS VARCHAR)") for c in manifest.COLUMNS) + ")"

#: crc32 is not a DuckDB function: it is made bit by bit, as its definition has it.
CRC32 = """
crc_table AS (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS UBIGINT), c >> 1) ELSE c >> 1 END) AS v FROM range(256) AS t(i)),
crc_values AS (SELECT list(v ORDER BY i) AS vs FROM crc_table),
crc AS (SELECT doc_id, xor(CAST(4294967295 AS UBIGINT), list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda c, b: xor(vs[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8))) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_values)"""

MANIFEST = f"""
WITH RECURSIVE {CRC32},
docs AS (SELECT d.*, {LEAF} AS leaf, CASE WHEN crc % 3 = 0 THEN {LEAF.replace("CAST(text AS VARCHAR)", TAMPERED)} ELSE {LEAF} END AS found
         FROM documents d LEFT JOIN crc USING (doc_id)),
leaves AS (SELECT doc_id, leaf, found, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS g,
                  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM docs),
node(g, lvl, i, n, h) AS (
  SELECT g, 0, i, n, leaf FROM leaves
  UNION ALL SELECT g, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY g, lvl, i // 8, n),
subs AS (SELECT g, lvl AS depth, h, row_number() OVER (ORDER BY g) - 1 AS place FROM node WHERE n = 1),
root AS (SELECT sha256(string_agg(h, '' ORDER BY g)) AS root, list(h ORDER BY g) AS hs FROM subs),
run AS (SELECT g, lvl, i // 8 AS up, list(h ORDER BY i) AS hs FROM node WHERE n > 1 GROUP BY g, lvl, i // 8),
fold(doc_id, g, i, lvl, depth, pos, leaf, acc, proof) AS (
  SELECT doc_id, g, i, 0, depth, i, leaf, found, '' FROM leaves JOIN subs USING (g)
  UNION ALL
  SELECT doc_id, fold.g, fold.i, fold.lvl + 1, depth, pos // 8, leaf,
         sha256(array_to_string(hs[1 : pos % 8], '') || acc || array_to_string(hs[pos % 8 + 2 :], '')),
         proof || array_to_string(hs[1 : pos % 8], '') || array_to_string(hs[pos % 8 + 2 :], '')
  FROM fold JOIN run ON run.g = fold.g AND run.lvl = fold.lvl AND run.up = pos // 8 WHERE fold.lvl < depth)
SELECT doc_id, leaf, subs.h AS subroot, root, sha256(proof || array_to_string(hs[1 : place], '') || array_to_string(hs[place + 2 :], '')) AS proof_sha256,
       sha256(array_to_string(hs[1 : place], '') || acc || array_to_string(hs[place + 2 :], '')) AS folded_root, folded_root = root AS verified
FROM fold JOIN subs USING (g), root WHERE fold.lvl = fold.depth
"""

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM_WORDS} AS w FROM documents),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM df, total),
q AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({ALNUM_WORDS}) AS t FROM benchmark) GROUP BY i, item_id, t),
part AS (SELECT i, item_id, r, doc_id, times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_docs) // n_words))) AS score
         FROM q JOIN weight USING (t) JOIN tf USING (t) JOIN d USING (r), total),
scored AS (SELECT i, item_id, r, doc_id, CAST(sum(score) AS BIGINT) AS score FROM part GROUP BY ALL HAVING sum(score) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM scored QUALIFY rank <= 20
"""

ORACLES = {
    "op13_ranked_search": RANKED,
    "op11_merkle_manifest": MANIFEST,
    "op4_minmax_near_dedup": NEAR_DUPLICATES.format(documents="documents"),
    "op10_warc_revisits": WARC,
    "op8_benchmark_decontamination": DECONTAMINATION.format(documents="documents"),
}
