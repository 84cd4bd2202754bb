"""DuckDB SQL that gives the rows of the queries, where SQL can."""

from __future__ import annotations

EXACT = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || ({value}), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


#: crc32 of a decimal number's digits, bit by bit; 3988292384 is the reversed polynomial.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
          lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                        lambda x, _: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))))"""

MERKLE = f"""
    WITH RECURSIVE
    own AS (SELECT doc_id, source, {_leaf('text')} AS leaf,
                   CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS changed
            FROM documents),
    leaves AS (SELECT doc_id, coalesce('s' || source, '') AS tree, leaf, changed, count(*) OVER (PARTITION BY source) AS width,
                      row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM own),
    nodes AS (SELECT tree, 0 AS level, idx, width, leaf AS digest FROM leaves
              UNION ALL
              SELECT tree, level + 1, idx // 3, (width + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
              FROM nodes WHERE width > 1 GROUP BY tree, level, idx // 3, width),
    subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees
                 FROM nodes WHERE width = 1),
    tops AS (SELECT 0 AS level, place AS idx, trees AS width, digest FROM subroots
             UNION ALL
             SELECT level + 1, idx // 3, (width + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
             FROM tops WHERE width > 1 GROUP BY level, idx // 3, width),
    every AS (SELECT tree, level, idx, width, digest FROM nodes UNION ALL SELECT 'r', level, idx, width, digest FROM tops),
    paths AS (SELECT tree, idx, tree AS at, 0 AS step, 0 AS level, idx AS here, width FROM leaves
              UNION ALL
              SELECT p.tree, p.idx, CASE WHEN p.width > 1 THEN p.at ELSE 'r' END, p.step + 1,
                     CASE WHEN p.width > 1 THEN p.level + 1 ELSE 0 END, CASE WHEN p.width > 1 THEN p.here // 3 ELSE s.place END,
                     CASE WHEN p.width > 1 THEN (p.width + 2) // 3 ELSE s.trees END
              FROM paths p JOIN subroots s USING (tree) WHERE p.width > 1 OR p.at <> 'r'),
    steps AS (SELECT p.tree, p.idx, p.step, p.width > 1 AS folds,
                     coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx < p.here), '') AS before,
                     coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx > p.here), '') AS after
              FROM paths p JOIN every n ON n.tree = p.at AND n.level = p.level AND n.idx // 3 = p.here // 3
              GROUP BY p.tree, p.idx, p.step, p.here, p.width),
    folded AS (SELECT tree, idx, 0 AS step, coalesce(changed, leaf) AS digest FROM leaves
               UNION ALL
               SELECT f.tree, f.idx, f.step + 1, CASE WHEN s.folds THEN sha256(s.before || f.digest || s.after) ELSE f.digest END
               FROM folded f JOIN steps s USING (tree, idx, step)),
    proofs AS (SELECT tree, idx, sha256(string_agg(before || after, '' ORDER BY step) FILTER (folds)) AS own,
                      max(step) + 1 AS last FROM steps GROUP BY tree, idx)
    SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(p.own, sha256('')) AS proof_sha256,
           f.digest AS folded_root, f.digest = r.digest AS verified
    FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN tops r ON r.width = 1 JOIN proofs p ON p.tree = l.tree AND p.idx = l.idx
         JOIN folded f ON f.tree = l.tree AND f.idx = l.idx AND f.step = p.last"""


def _after(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN regexp_replace(substr({url}, instr({url}, '://') + 3), '(?s)#.*$', '') END"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _host(url: str) -> str:
    return f"coalesce({_lower(f'''regexp_extract({_after(url)}, '(?s)^([^/?#]*)', 1)''')}, '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({_after(url)}, '(?s)^[^/?#]*([^?#]*)', 1), '')"


def _scheme(url: str) -> str:
    return _lower(f"split_part({url}, '://', 1)")


def _node(url: str) -> str:
    return f"({_scheme(url)} || '://' || {_host(url)} || regexp_extract({_after(url)}, '(?s)^[^/?#]*(.*)$', 1))"


def _resolved(url: str, target: str) -> str:
    origin = f"{_scheme(url)} || '://' || {_host(url)}"
    return f"""CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {target}
        WHEN regexp_matches({target}, '^(#|$)|^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
        WHEN starts_with({target}, '//') THEN {_scheme(url)} || ':' || {target}
        WHEN starts_with({target}, '/') THEN {origin} || {target}
        WHEN starts_with({target}, '?') THEN {origin} || {_path(url)} || {target}
        ELSE {origin} || CASE WHEN {_path(url)} = '' THEN '/' ELSE regexp_replace({_path(url)}, '(?s)[^/]*$', '') END || {target} END"""


def url_filter(rules: tuple[tuple[str, str, str], ...]) -> str:
    """Rules, links, classes by a recursive closure, and verdicts."""
    from doseloom.llm import urlfilter
    quoted = {k: getattr(urlfilter, k).replace("'", "''") for k in ("HIDDEN", "TAG", "CANONICAL", "REFRESH", "HREF", "TARGET")}
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    own = """(SELECT {what} FROM rules r WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
              ORDER BY length(r.host || r.path) DESC, r.verdict, r.host || r.path LIMIT 1)"""
    return rf"""
    WITH RECURSIVE rules(host, path, verdict) AS (VALUES {values}),
    tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '{quoted["HIDDEN"]}', ' ', 'g'), '{quoted["TAG"]}')) AS tag FROM pages),
    targets AS (SELECT url, trim(replace(CASE
                    WHEN regexp_matches(tag, '{quoted["CANONICAL"]}') THEN regexp_extract(tag, '{quoted["HREF"]}', 1)
                         || regexp_extract(tag, '{quoted["HREF"]}', 2) || regexp_extract(tag, '{quoted["HREF"]}', 3)
                    WHEN regexp_matches(tag, '{quoted["REFRESH"]}') THEN regexp_extract(tag, '{quoted["TARGET"]}', 1) END, '&amp;', '&')) AS target
                FROM tags),
    absolute AS (SELECT url, {_resolved("url", "target")} AS target FROM targets),
    found AS (SELECT DISTINCT {_node("url")} AS a, {_node("target")} AS b FROM absolute),
    edges AS (SELECT a, b FROM found WHERE a <> b UNION SELECT b, a FROM found WHERE a <> b),
    reach AS (SELECT DISTINCT a AS url, a AS other FROM edges
              UNION SELECT r.url, e.b FROM reach r JOIN edges e ON e.a = r.other),
    linked AS (SELECT DISTINCT other AS node, {_host("other")} AS host, {_path("other")} AS path FROM reach),
    strong AS (SELECT node, {own.format(what="r.verdict")} AS verdict FROM linked u),
    decided AS (SELECT r.url AS node, min(s.verdict) AS decision FROM reach r JOIN strong s ON s.node = r.other GROUP BY r.url),
    urls AS (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, {_node("url")} AS node FROM pages),
    judged AS (SELECT u.*, {own.format(what="{'rule': r.host || r.path, 'verdict': r.verdict}")} AS own FROM urls u)
    SELECT j.page_id, j.host, j.path, j.own.rule AS rule, coalesce(j.own.verdict, d.decision, 'allow') AS verdict
    FROM judged j LEFT JOIN decided d ON d.node = j.node"""


NEGATIVES = """
    WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS rid
                  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (SELECT a.rid AS anchor, a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same,
                      list_inner_product(a.v, r.v)::BIGINT AS score
               FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.rid <> r.rid),
    positives AS (SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
    inside AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                      row_number() OVER (PARTITION BY p.anchor, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
               FROM positives p JOIN scores s ON s.anchor = p.anchor AND NOT s.same
                    AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
    SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM inside WHERE rank <= 5"""

#: The text with A-Z, and nothing else, lower-cased.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
    WITH low AS (
        SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    item AS (
        SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    gram AS (
        SELECT DISTINCT item, least(len(w), 10) AS m, w[i:i + least(len(w), 10) - 1] AS g
        FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT m FROM gram),
    met AS (
        SELECT r, i, t.m, item FROM (
            SELECT r, m, i, w[i:i + m - 1] AS g
            FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM low, sizes WHERE len(w) >= m)) t JOIN gram USING (m, g)),
    hit AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + m)) AS place FROM met) GROUP BY r),
    named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT r, item FROM met WHERE item IS NOT NULL) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
    FROM low LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""

REPEATS = r"""
    WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    page AS (  -- 500 strings each, since a place far into a long text is slow to reach
        SELECT doc_id, p, substring(h, 2 * p + 1, 1098) AS h FROM (SELECT doc_id, h, unnest(range(0, strlen(h) // 2 - 49, 500)) AS p FROM doc)),
    string AS (
        SELECT doc_id, p + i AS i, substring(h, 2 * i + 1, 100) AS s
        FROM (SELECT doc_id, p, h, unnest(range(0, strlen(h) // 2 - 49)) AS i FROM page)),
    first AS (SELECT s, min(doc_id) AS d FROM string GROUP BY s HAVING min(doc_id) < max(doc_id)),
    mark AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS ahead FROM string JOIN first USING (s) WHERE doc_id > d),
    run AS (
        SELECT doc_id, min(i) AS a, max(i) + 50 AS b
        FROM (SELECT *, sum((ahead IS NULL OR i > ahead + 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM mark)
        GROUP BY doc_id, k),
    runs AS (
        SELECT doc_id, count(*) AS n, sum(b - a) AS size, list_concat([0], list(b ORDER BY a)) AS begins, list(a ORDER BY a) AS ends
        FROM run GROUP BY doc_id)
    SELECT doc_id, strlen(h) // 2 AS n_bytes, coalesce(size, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
           sha256(CASE WHEN n IS NULL THEN unhex(h) ELSE unhex(array_to_string(
               list_transform(begins, lambda b, k: substring(h, 2 * b + 1, 2 * (coalesce(ends[k], strlen(h) // 2) - b))), '')) END) AS kept_sha256
    FROM doc LEFT JOIN runs USING (doc_id)"""

NEAR_DUPLICATES = rf"""
    WITH RECURSIVE doc AS (
        SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    class AS (SELECT w, min(doc_id) AS c FROM doc WHERE len(w) > 0 GROUP BY w),
    shingle AS (
        SELECT DISTINCT c, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS s
        FROM (SELECT c, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM class)),
    numbered AS (SELECT c, dense_rank() OVER (ORDER BY s) AS s FROM shingle),
    size AS (SELECT c, count(*) AS n FROM numbered GROUP BY c),
    pair AS (SELECT x.c AS a, y.c AS b, count(*) AS n FROM numbered x JOIN numbered y ON x.s = y.s AND x.c < y.c GROUP BY ALL),
    link AS (
        SELECT a, b FROM pair JOIN size x ON x.c = a JOIN size y ON y.c = b WHERE 100 * pair.n >= 85 * (x.n + y.n - pair.n)),
    edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(c, m) AS (SELECT a, a FROM edge UNION SELECT b, m FROM reach JOIN edge ON a = c WHERE m < b),
    label AS (SELECT c, min(m) AS m FROM reach GROUP BY c)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, class.c, doc_id) AS component_id, doc_id = coalesce(m, class.c, doc_id) AS kept
    FROM doc LEFT JOIN class USING (w) LEFT JOIN size USING (c) LEFT JOIN label USING (c)"""
