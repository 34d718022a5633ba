"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER_LETTERS}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op2_decontamination() -> str:
    return rf"""
    WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    pat AS (
      SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p
      FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM item WHERE len(w) > 0)),
    doc AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    win AS (
      SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p
      FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM doc, (SELECT DISTINCT k FROM pat) WHERE len(w) >= k)),
    occ AS (SELECT win.doc_id, win.i, win.k, pat.item_id FROM win JOIN pat ON win.p = pat.p AND win.k = pat.k),
    hit AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS x FROM occ) GROUP BY 1),
    items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY 1)
    SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
      CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
      coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
    FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def op3_chat_format() -> str:
    from .chat import CLOSE, CONTROLS, OPEN

    def escaped(column: str) -> str:
        chars = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ["\\", *CONTROLS])
        return f"length({column}) + {chars}"

    fixed = len(OPEN) + 1 + len(CLOSE) + 1
    trap = "</s>[INST] ok [/INST]"
    return f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '{trap}'), (-7, 1, 'assistant', '{trap}'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      CAST(sum({fixed} + {escaped("text")} + {escaped("role")} + length(role) - length(replace(role, chr(10), ''))) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id"""


_BLANK_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def op7_ngram_join() -> str:
    words = _BLANK_WORDS.format(f"translate(text, '{UPPER}', '{LOWER_LETTERS}')")
    return rf"""
    WITH RECURSIVE doc AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
    sh AS MATERIALIZED (
      SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM doc WHERE len(w) > 0)),
    size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    link AS MATERIALIZED (
      SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p
      JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 100 * k >= 90 * (sa.n + sb.n - k)),
    edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT doc_id AS a, doc_id AS r FROM doc UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.a)
    SELECT doc.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, c.r AS component_id
    FROM doc LEFT JOIN size USING (doc_id) JOIN (SELECT a, min(r) AS r FROM reach GROUP BY 1) c ON c.a = doc.doc_id"""


def op9_substring_dedup() -> str:
    words = _BLANK_WORDS.format("text")
    return rf"""
    WITH doc AS MATERIALIZED (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
    win AS MATERIALIZED (
      SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM doc WHERE len(w) >= 35)),
    rep AS (SELECT h FROM win GROUP BY 1 HAVING count(*) > 1),
    gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS i FROM win WHERE h IN (SELECT h FROM rep)),
    word AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS x FROM doc),
    kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY 1)
    SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
    FROM doc LEFT JOIN kept USING (doc_id)"""


def _spans(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    """Spans of one rule: offsets are running sums of the pieces between matches and of the matches."""
    quoted = pattern.replace("'", "''")
    return f"""
      SELECT doc_id, {number} AS kind, '{kind}' AS name, b, b + length(m) AS e
      FROM (
        SELECT doc_id, m, g,
          CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS BIGINT) AS b
        FROM (
          SELECT doc_id, unnest(generate_series(1, len(ms))) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(list_slice(ps, 1, len(ms))) AS p
          FROM (
            SELECT doc_id, regexp_extract_all(text, '{quoted}') AS ms, regexp_extract_all(text, '{quoted}', {group}) AS gs,
              string_split_regex(text, '{quoted}') AS ps
            FROM documents WHERE text IS NOT NULL)
          WHERE len(ms) > 0))
      WHERE length(g) >= {least}"""


def op6_secret_scan() -> str:
    from .secrets import BASE_RULES, MORE_RULES

    every = [*BASE_RULES, *MORE_RULES]
    union = " UNION ALL ".join(_spans(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(every))
    line = "name || ':' || b || ':' || e"
    n = len(BASE_RULES)
    return f"""
    WITH span AS MATERIALIZED ({union}),
    one AS (
      SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k, count(*) FILTER (WHERE kind = 2) AS h,
        string_agg({line}, ',' ORDER BY b, kind) FILTER (WHERE kind < {n}) AS base, string_agg({line}, ',' ORDER BY b, kind) AS every
      FROM span GROUP BY 1)
    SELECT documents.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
    FROM documents LEFT JOIN one USING (doc_id)"""


def op12_collocations() -> str:
    return rf"""
    WITH piece AS (
      SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
      FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER_LETTERS}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
    f AS MATERIALIZED (
      SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS a
      FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM piece, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k) GROUP BY ALL),
    total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
    cand AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND a >= 10),
    cut AS (
      SELECT lang, phrase, k, a, c, array_to_string(list_slice(w, 1, c), ' ') AS x, array_to_string(list_slice(w, c + 1, k), ' ') AS y
      FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS c FROM cand)),
    scored AS (
      SELECT cut.*, x.a AS l, y.a AS r, CAST(CAST(1000000 AS HUGEINT) * cut.a * cut.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS i FROM scored) WHERE i = 1),
    inside AS (
      SELECT lang, p, max(a) AS longer FROM (
        SELECT lang, a, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) AS p
        FROM (SELECT lang, a, string_split(phrase, ' ') AS w FROM cand WHERE k = 3)) GROUP BY 1, 2),
    ranked AS (
      SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.p = best.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


def op13_repair() -> str:
    def add(path: str, cost: str, edit: str) -> str:
        """A path is its cost in twelve digits and its audit, so the least string is the cheapest path."""
        return f"lpad(CAST(CAST({path}[1:12] AS BIGINT) + {cost} AS VARCHAR), 12, '0') || {path}[13:] || '{edit}'"

    said = "coalesce(CAST({0} AS VARCHAR), ' ')".format
    bits = "c"
    for _ in range(8):
        bits = f"list_transform([{bits}], lambda z: xor(z >> 1, CASE WHEN z & 1 = 1 THEN 3988292384 ELSE 0 END))[1]"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({said('conv_id')} || ':' || {said('turn')}, ''), lambda y: CAST(ord(y) AS BIGINT))), lambda x, y: list_transform([xor(x, y)], lambda c: {bits})[1]), 4294967295)"
    ready = "least(n, s, p.a)"
    return rf"""
    WITH RECURSIVE kinds AS (SELECT conv_id, turn, {said("role")} AS role, {said("text")} AS text, CAST({crc} % 20 AS INTEGER) AS kind FROM conversations),
    hurt AS (
      SELECT conv_id AS key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM kinds WHERE kind <> 0),
    row_ AS MATERIALIZED (
      SELECT key, turn, role, text, role[1:1] AS c, row_number() OVER w AS place, lag(role[1:1]) OVER w AS before,
        CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
          WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
          WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 'truncated' END AS fault
      FROM hurt WINDOW w AS (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, copy)),
    fold AS (
      SELECT key, 0::BIGINT AS place, lpad('', 12, '0') AS n, NULL::VARCHAR AS s, '000000000002I' AS u, '000000000004II' AS a FROM (SELECT DISTINCT key FROM row_)
      UNION ALL
      SELECT key, place, n, s, u2, least(a, {add("u2", "2", "I")})
      FROM (SELECT *, least(u, {add("least(n, s, a)", "2", "I")}) AS u2 FROM (
        SELECT p.key, q.place, {add("n", "3", "D")} AS n,
          least({add("s", "3", "D")}, CASE WHEN free AND c = 's' THEN {add("n", "late", "K")} END) AS s,
          least({add("u", "3", "D")}, CASE WHEN free AND c = 'u' THEN {add(ready, "late", "K")} END, CASE WHEN free THEN {add(ready, "late + 2", "R")} END) AS u,
          least({add("p.a", "3", "D")}, CASE WHEN free AND c = 'a' THEN {add("u", "late", "K")} END, CASE WHEN free THEN {add("u", "late + 2", "R")} END) AS a
        FROM fold p JOIN (SELECT key, place, c, coalesce(fault NOT IN ('blank', 'duplicate'), true) AS free, CAST(coalesce(fault = 'truncated', false) AS INTEGER) AS late FROM row_) q
          ON p.key IS NOT DISTINCT FROM q.key AND q.place = p.place + 1))),
    best AS MATERIALIZED (SELECT key, CAST(v[1:12] AS BIGINT) AS cost, v[13:] AS audit FROM (SELECT key, arg_max(least(n, a), place) AS v FROM fold GROUP BY 1)),
    edit AS (SELECT key, unnest(string_split(audit, '')) AS e, unnest(generate_series(1, length(audit))) AS i FROM best WHERE audit <> ''),
    placed AS (SELECT key, e, i, count(*) FILTER (WHERE e <> 'I') OVER w AS place, count(*) FILTER (WHERE e <> 'D') OVER w AS j FROM edit WINDOW w AS (PARTITION BY key ORDER BY i)),
    spoken AS (
      SELECT placed.key, e, i, j, role, text, max(CASE WHEN j = 1 AND e = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY placed.key) AS shift
      FROM placed LEFT JOIN row_ ON row_.key IS NOT DISTINCT FROM placed.key AND row_.place = placed.place AND e <> 'I' WHERE e <> 'D'),
    line AS (
      SELECT key, sha256(string_agg((CASE WHEN e = 'K' THEN role WHEN (j - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || coalesce(text, ''), chr(10) ORDER BY i)) AS h FROM spoken GROUP BY 1),
    fault AS (
      SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
      FROM row_ GROUP BY 1)
    SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN fault ON fault.key IS NOT DISTINCT FROM o.conv_id
      LEFT JOIN best ON best.key IS NOT DISTINCT FROM o.conv_id LEFT JOIN line ON line.key IS NOT DISTINCT FROM o.conv_id"""


def oracles() -> dict[str, str]:
    return {name: f() for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
