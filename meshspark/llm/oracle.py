"""DuckDB SQL for the queries that SQL can express, in the same steps."""

from __future__ import annotations

from . import ibf as B, mixing, quality_rules as Q, url_filter as U

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def quality_rules_sql() -> str:
    measures = {
        "symbols_per_word": "n_symbols / w", "exclaims_per_word": "exclaims / w", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / w",
        "upper_share": "upper / greatest(word_chars, 1)", "mean_word_chars": "word_chars / w", "short_word_share": "short / w", "distinct_word_share": "distinct_words / w",
    }
    cells = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, CASE WHEN {k} > {Q.TINY} THEN ceil(ln({k}) / ln({Q.GAMMA!r}::DOUBLE))::INT ELSE {Q.ZERO_BUCKET} END AS bucket FROM good" for k in measures)
    both = ", ".join(f"'{k}'" for k, (two, *_) in Q.MEASURES.items() if two)
    sides = ", ".join(f"max(CASE WHEN measure = '{k}' THEN high END) AS high_{k}, max(CASE WHEN measure = '{k}' THEN low END) AS low_{k}" for k in measures)
    room = lambda k: f"{Q.MEASURES[k][1]} / " + ("sqrt(w)" if Q.MEASURES[k][2] == "root" else f"greatest(m.{Q.MEASURES[k][2]}, 1)")
    inside = " AND ".join(f"m.{k} >= l.low_{k} - {room(k)} AND m.{k} <= l.high_{k} + {room(k)}" for k in measures)
    drawn = lambda q: f"(g.rows * g.{q} + {Q.PRIOR} * ((l.rows * l.{q} + {Q.PRIOR} * a.{q}) / (l.rows + {Q.PRIOR}))) / (g.rows + {Q.PRIOR}) AS {q}"
    return rf"""
    WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
    wins AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM words WHERE len(ws) >= 8)),
    again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
    cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY 1),
    lines AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM words),
    counts AS (SELECT l.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::DOUBLE AS n_lines, length(regexp_replace(text, '[^!]+', '', 'g'))::DOUBLE AS exclaims,
      length(regexp_replace(text, '[^A-Z]+', '', 'g'))::DOUBLE AS upper, len(list_filter(ws, lambda x: length(x) <= 3))::DOUBLE AS short, len(list_distinct(ws))::DOUBLE AS distinct_words, greatest(len(ws), 1)::DOUBLE AS w
      FROM lines l LEFT JOIN cover c ON c.doc_id = l.doc_id),
    measured AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"({e})::DOUBLE AS {k}" for k, e in measures.items())} FROM counts),
    good AS (SELECT * FROM measured WHERE NOT base_failed),
    fine AS (SELECT lang, source, measure, bucket, count(*) AS n FROM ({cells}) GROUP BY ALL),
    sketch AS (SELECT 0 AS level, lang, source, measure, bucket, n FROM fine UNION ALL SELECT 1, lang, NULL, measure, bucket, sum(n) FROM fine GROUP BY lang, measure, bucket UNION ALL SELECT 2, NULL, NULL, measure, bucket, sum(n) FROM fine GROUP BY measure, bucket),
    ranked AS (SELECT *, CASE WHEN bucket = {Q.ZERO_BUCKET} THEN 0.0 ELSE 2 * pow({Q.GAMMA!r}::DOUBLE, bucket) / ({Q.GAMMA!r}::DOUBLE + 1) END AS value, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS rows FROM sketch),
    quart AS (SELECT level, lang, source, measure, any_value(rows) AS rows, min(CASE WHEN upto >= 0.25 * rows THEN value END) AS q1, min(CASE WHEN upto >= 0.75 * rows THEN value END) AS q3 FROM ranked GROUP BY ALL),
    drawn AS (SELECT g.lang, g.source, g.measure, {drawn("q1")}, {drawn("q3")} FROM quart g JOIN quart l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM g.lang AND l.measure = g.measure JOIN quart a ON a.level = 2 AND a.measure = g.measure WHERE g.level = 0),
    fences AS (SELECT lang, source, measure, q3 + {Q.REACH} * greatest(q3 - q1, {Q.LEAST}) AS high, CASE WHEN measure IN ({both}) THEN q1 - {Q.REACH} * greatest(q3 - q1, {Q.LEAST}) ELSE '-inf'::DOUBLE END AS low FROM drawn),
    limits AS (SELECT lang, source, {sides} FROM fences GROUP BY lang, source)
    SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, false) AS kept
    FROM measured m LEFT JOIN limits l ON l.lang IS NOT DISTINCT FROM m.lang AND l.source IS NOT DISTINCT FROM m.source
    """


def mixing_sql(block: int = mixing.BLOCK) -> str:
    weights = "[" + ", ".join(f"{w}.0::DOUBLE" for w in mixing.WEIGHTS) + "]"
    return f"""
    WITH sized AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('mix' || coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')) AS place FROM documents),
    sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
    placed AS (SELECT *, {weights}[1 + k % {len(mixing.WEIGHTS)}] AS weight, ({mixing.MOST_REPEATS} * source_size)::DOUBLE AS cap FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sizes)),
    step AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER () AS weights, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before FROM placed
      WINDOW o AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    levels AS (SELECT *, (total - cap_before) / (weights - weight_before) AS level FROM step),
    share AS (SELECT level FROM levels WHERE cap > level * weight ORDER BY cap / weight, k LIMIT 1),
    goals AS (SELECT source, source_size, k, least(cap, coalesce((SELECT level FROM share), 'inf'::DOUBLE) * weight) AS target FROM levels),
    edges AS (SELECT k, sum(target) OVER (ORDER BY k) AS high, coalesce(sum(target) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM goals),
    whole AS (SELECT sum(target) AS t FROM goals),
    slots AS (SELECT n, list_sum(list_transform(range(0, 40), lambda b: ((n >> b) & 1) * pow(0.5, b + 1))) * (SELECT t FROM whole) AS x FROM (SELECT unnest(range(0, (SELECT greatest(1, round_even(t / {block}, 0))::BIGINT FROM whole))) AS n)),
    turns AS (SELECT e.k, row_number() OVER (PARTITION BY e.k ORDER BY n) - 1 AS rank FROM slots JOIN edges e ON x >= low AND x < high),
    blocks AS (SELECT k, greatest(ceil(source_size / {block}), 1)::BIGINT AS n FROM goals),
    times AS (SELECT t.k, rank % b.n AS block, count(*) AS times FROM turns t JOIN blocks b ON b.k = t.k WHERE rank < {mixing.MOST_REPEATS} * b.n GROUP BY 1, 2),
    starts AS (SELECT d.*, g.k, g.source_size, g.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized d JOIN goals g ON g.source IS NOT DISTINCT FROM d.source),
    parts AS (SELECT *, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS block FROM starts WHERE size > 0),
    taken AS (SELECT p.k, p.start, sum((least(start + size, (p.block + 1) * {block}) - greatest(start, p.block * {block})) * times) AS taken FROM parts p JOIN times t ON t.k = p.k AND t.block = p.block GROUP BY 1, 2)
    SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(t.taken, 0)::BIGINT AS taken FROM starts s LEFT JOIN taken t ON t.k = s.k AND t.start = s.start AND s.size > 0
    """


def url_filter_sql(rules) -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}', {k})" for k, (v, h, p) in enumerate(rules))
    begin, end, top = "repeat(chr(2), %d)" % U.ORDER, "chr(3)", U.ORDER + 1
    tables, shorter = [], None
    enough = lambda a, r: f"({a} >= (SELECT la FROM least_counts) OR {r} >= (SELECT lr FROM least_counts))"
    for n in range(1, top + 1):
        own = f"(SELECT right(gram, {n}) AS gram, sum(a) AS a, sum(r) AS r FROM grams GROUP BY 1)"
        before = f"(SELECT substring(gram, {top + 1 - n}, {n - 1}) AS context, sum(a) AS ca, sum(r) AS cr FROM grams GROUP BY 1)"
        low = f"JOIN {shorter} s ON s.gram = substring(o.gram, 2)" if shorter else ""
        pa, pr = ("s.pa", "s.pr") if shorter else (f"{1.0 / U.ALPHABET!r}::DOUBLE", f"{1.0 / U.ALPHABET!r}::DOUBLE")
        tables.append(f"model{n} AS (SELECT o.gram, (a + {U.WEIGHT} * {pa}) / (ca + {U.WEIGHT}) AS pa, (r + {U.WEIGHT} * {pr}) / (cr + {U.WEIGHT}) AS pr FROM {own} o JOIN {before} b ON b.context = substring(o.gram, 1, {n - 1}) {low} WHERE {enough('a', 'r')})")
        if n > 1:
            tables.append(f"back{n - 1} AS (SELECT context, ln((cr + {U.WEIGHT}) / (ca + {U.WEIGHT})) AS back FROM {before} WHERE {enough('ca', 'cr')})")
        shorter = f"model{n}"
    joins = " ".join(f"LEFT JOIN model{n} m{n} ON m{n}.gram = right(g.gram, {n})" for n in range(1, top + 1))
    joins += " ".join(f" LEFT JOIN back{m} b{m} ON b{m}.context = substring(g.gram, {top - m}, {m})" for m in range(1, top))
    longer = lambda n: "".join(f" + coalesce(b{m}.back, 0)" for m in range(max(n, 1), top))
    best = "coalesce(" + ", ".join(f"ln(m{n}.pa) - ln(m{n}.pr){longer(n)}" for n in range(top, 0, -1)) + f", (SELECT start FROM least_counts){longer(0)})"
    return f"""
    WITH rules(verdict, host, path, place) AS (VALUES {values}),
    split AS (SELECT page_id, row_number() OVER () AS row, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
    parts AS (SELECT *, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM split),
    fits AS (SELECT p.row, arg_max(r.host || r.path, length(r.host || r.path) * 1000 - place) AS rule, arg_max(verdict, length(r.host || r.path) * 1000 - place) AS verdict FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY 1),
    known AS (SELECT p.row, page_id, p.host, p.path, rule, verdict, substring(md5(p.host || substring(rest, length(p.host) + 1)), 1, 1) IN ('0', '1', '2') AS held, {begin} || p.host || substring(rest, length(p.host) + 1) || {end} AS t FROM parts p LEFT JOIN fits f ON f.row = p.row),
    places AS (SELECT row, verdict, held, substring(t, i::BIGINT, {top}) AS gram FROM (SELECT row, verdict, held, t, unnest(range(1, length(t) - {U.ORDER} + 1)) AS i FROM known)),
    grams AS (SELECT gram, sum((verdict = 'allow')::INT) AS a, sum((verdict <> 'allow')::INT) AS r FROM places WHERE verdict IS NOT NULL AND NOT held GROUP BY 1),
    least_counts AS (SELECT greatest(2.0, coalesce(sum(a), 0) / {float(U.NODES)}) AS la, greatest(2.0, coalesce(sum(r), 0) / {float(U.NODES)}) AS lr, ln((coalesce(sum(r), 0) + {U.WEIGHT}) / (coalesce(sum(a), 0) + {U.WEIGHT})) AS start FROM grams),
    {", ".join(tables)},
    scored AS (SELECT row, avg({best}) AS ratio FROM places g {joins} GROUP BY 1),
    cells AS (SELECT least(greatest(floor(ratio * {U.CELLS}), {-20 * U.CELLS}), {20 * U.CELLS})::INT AS cell, sum((verdict = 'allow')::INT) AS a, sum((verdict <> 'allow')::INT) AS r FROM scored s JOIN known k ON k.row = s.row WHERE verdict IS NOT NULL AND held GROUP BY 1),
    sums AS (SELECT cell, sum(a) OVER o AS lost, sum(r) OVER o AS caught, sum(a) OVER () AS na, sum(r) OVER () AS nr FROM cells WINDOW o AS (ORDER BY cell)),
    choices AS (SELECT (SELECT min(cell) FROM cells) AS cut, 1.0::DOUBLE AS cost UNION ALL SELECT cell + 1, lost / na + (nr - caught) / nr FROM sums),
    cutoff AS (SELECT CASE WHEN (SELECT coalesce(min(na), 0) = 0 OR coalesce(min(nr), 0) = 0 FROM sums) THEN 0.0 ELSE (SELECT cut FROM choices ORDER BY round(cost, 11), cut LIMIT 1) / {float(U.CELLS)} END AS c)
    SELECT page_id, host, path, rule, coalesce(k.verdict, CASE WHEN ratio >= (SELECT c FROM cutoff) THEN 'allow' ELSE 'block' END) AS verdict FROM known k JOIN scored s ON s.row = k.row
    """


def manifest_sql() -> str:
    """Trees and proofs by recursion; crc32 of an id by its bits, since DuckDB has none."""
    field = lambda c: f"coalesce(octet_length(encode(({c})::VARCHAR))::VARCHAR || ':' || ({c})::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten(list_transform(list_filter(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: c <> ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"
    grown = lambda name, base: f"{name} AS ({base} UNION ALL SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 8, n)"
    climb = """SELECT f.doc_id, f.tree, f.level + 1, f.pos // 8, any_value(f.leaf), any_value(f.subroot), any_value(f.place),
      sha256(string_agg(CASE WHEN m.pos = f.pos THEN f.digest ELSE m.digest END, '' ORDER BY m.pos)), any_value(f.proof) || coalesce(string_agg(m.digest, '' ORDER BY m.pos) FILTER (WHERE m.pos <> f.pos), '')
      FROM {0} f JOIN {1} m ON m.tree = f.tree AND m.level = f.level AND m.pos // 8 = f.pos // 8 AND m.n > 1 GROUP BY f.row_no, f.doc_id, f.tree, f.level, f.pos"""
    fold = lambda name, nodes, base: f"{name} AS ({base} UNION ALL {climb.format(name, nodes).replace('SELECT f.doc_id', 'SELECT f.row_no, f.doc_id')})"
    return f"""
    WITH RECURSIVE leaves AS (SELECT row_number() OVER () AS row_no, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} END AS tampered FROM documents),
    places AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
    {grown("nodes", "SELECT tree, 0 AS level, pos, n, leaf AS digest FROM places")},
    roots AS (SELECT tree, digest FROM nodes WHERE n = 1),
    {grown("upper", "SELECT 0::BIGINT AS tree, 0 AS level, tree AS pos, count(*) OVER () AS n, digest FROM roots")},
    {fold("low", "nodes", "SELECT row_no, doc_id, tree, 0 AS level, pos, leaf, leaf AS subroot, tree AS place, coalesce(tampered, leaf) AS digest, '' AS proof FROM places")},
    low_ends AS (SELECT * FROM low QUALIFY level = max(level) OVER (PARTITION BY row_no)),
    {fold("high", "upper", "SELECT l.row_no, l.doc_id, 0::BIGINT AS tree, 0 AS level, l.place AS pos, l.leaf, r.digest AS subroot, l.place, l.digest, l.proof FROM low_ends l JOIN roots r ON r.tree = l.place")},
    ends AS (SELECT * FROM high QUALIFY level = max(level) OVER (PARTITION BY row_no))
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified FROM ends, (SELECT digest AS root FROM upper WHERE n = 1)
    """


def fingerprints_sql() -> str:
    """Fingerprints by grouping digests into cells; likeness by plain sets, which peeling has to give back."""
    half = f"{B.HALF - 1}"
    mixed = lambda by: f"(((k >> 30) * {by[0]} + (k & {half}) * {by[1]} + 12345) % {B.PRIME})"
    digests = lambda text: f"list_distinct(list_transform(regexp_extract_all({text}, '{B.PARAGRAPH}'), lambda p: ('0x' || substr(md5(p), 1, 15))::BIGINT))"
    placed = " UNION ALL ".join(f"SELECT doc_id, which, {t * B.SIDE} + {mixed(by)} % {B.SIDE} AS cell, k, {mixed(B.CHECK)} AS c FROM keys" for t, by in enumerate(B.PLACES))
    near = lambda b: f"CASE WHEN len(own) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(own, {b}))::DOUBLE / len(list_distinct(list_concat(own, {b}))) END"
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    pairs AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text, length(text) AS n_chars FROM docs),
    edits AS (SELECT *, left(text, (n_chars - n_chars // 4)::BIGINT) || left(next_text, (n_chars // 4)::BIGINT) AS edited FROM pairs),
    sets AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {digests("text")} AS own, {digests("edited")} AS changed, {digests("next_text")} AS next FROM edits),
    keys AS (SELECT doc_id, 'own' AS which, unnest(own) AS k FROM sets UNION ALL SELECT doc_id, 'changed', unnest(changed) FROM sets),
    cells AS (SELECT doc_id, which, cell, count(*) AS n, bit_xor(k) AS k, bit_xor(c) AS c FROM ({placed}) GROUP BY ALL),
    every AS (SELECT doc_id, which, unnest(range({B.TABLES * B.SIDE})) AS cell FROM sets, (VALUES ('own'), ('changed')) w(which)),
    prints AS (SELECT doc_id, which, string_agg(format('{{:04x}}{{:015x}}{{:08x}}', coalesce(n, 0), coalesce(k, 0), coalesce(c, 0)), '' ORDER BY cell) AS p FROM every LEFT JOIN cells USING (doc_id, which, cell) GROUP BY doc_id, which)
    SELECT s.doc_id, n_chars::BIGINT AS n_chars, edited_sha256, a.p AS fingerprint, b.p AS edited_fingerprint, {near("changed")} AS near_edited, {near("next")} AS near_next
    FROM sets s JOIN prints a ON a.doc_id = s.doc_id AND a.which = 'own' JOIN prints b ON b.doc_id = s.doc_id AND b.which = 'changed'
    """
