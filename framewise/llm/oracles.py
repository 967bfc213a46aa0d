"""SQL of the queries that SQL can express whole, in DuckDB's dialect."""

from __future__ import annotations

from framewise.llm import quality_rules as rules

_WORD = r"[^\x20\x09-\x0D]+"


def op4() -> str:
    """Statistics by windows over all triples; sketches as bucket counts, merged by weight; the best cut of each by running sums."""
    ln = f"ln({rules.GAMMA!r}::DOUBLE)"
    metrics = {"symbols": "n_symbols / n_words", "dup_lines": "n_dup_lines / n_lines", "repeats": "n_repeat_words / n_words", "mean_word": "word_chars / n_words"}
    bucket = lambda x: f"CASE WHEN {x} > 0 THEN ceil(ln({x}) / {ln})::INT ELSE {rules.ZERO} END"
    union = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {e} AS x FROM s WHERE NOT base_failed" for m, e in metrics.items())
    place = " ".join(f"WHEN metric = '{m}' THEN {e}" for m, e in rules.AXES.items())
    two = ", ".join(f"'{m}'" for m in rules.TWO_SIDED)
    spread = f"{rules.SPREAD**2!r}::DOUBLE"
    limits = ", ".join(f"max({side}) FILTER (metric = '{m}') AS {side}_{m}" for m in metrics for side in ("high", "low"))
    fine = " AND ".join(f"coalesce({bucket(e)} <= high_{m}, true) AND coalesce({bucket(e)} >= low_{m}, true)" for m, e in metrics.items())
    return f"""
      WITH d AS (SELECT row_number() OVER () AS i, doc_id, lang, source, regexp_extract_all(t, '{_WORD}') AS w, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
                        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
      words AS (SELECT i, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
      triples AS (SELECT i, k, x AS a, lead(x, 1) OVER v AS b, lead(x, 2) OVER v AS c FROM words WINDOW v AS (PARTITION BY i ORDER BY k)),
      twice AS (SELECT i, k FROM (SELECT i, k, count(*) OVER (PARTITION BY i, a, b, c) AS n FROM triples WHERE c IS NOT NULL) WHERE n > 1),
      covered AS (SELECT i, count(DISTINCT k + o) AS n FROM twice, unnest([0, 1, 2]) AS u(o) GROUP BY i),
      s AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
              SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
                     (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines FROM d LEFT JOIN covered USING (i))),
      sketch AS (SELECT lang, source, metric, {bucket("x")} AS bucket, count(*)::DOUBLE AS n FROM ({union}) GROUP BY ALL),
      a AS (SELECT metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL), ta AS (SELECT *, {rules.PRIOR} * n / sum(n) OVER (PARTITION BY metric) AS lent FROM a),
      l AS (SELECT lang, metric, bucket, sum(n) AS n FROM (SELECT lang, metric, bucket, n FROM sketch UNION ALL SELECT k.lang, metric, bucket, lent FROM (SELECT DISTINCT lang, metric FROM sketch) k JOIN ta USING (metric)) GROUP BY ALL),
      tl AS (SELECT *, {rules.PRIOR} * n / sum(n) OVER (PARTITION BY lang, metric) AS lent FROM l),
      g AS (SELECT lang, source, metric, bucket, sum(n) AS n FROM (SELECT * FROM sketch UNION ALL
              SELECT k.lang, source, k.metric, bucket, lent FROM (SELECT DISTINCT lang, source, metric FROM sketch) k JOIN tl ON k.metric = tl.metric AND k.lang IS NOT DISTINCT FROM tl.lang) GROUP BY ALL),
      y AS (SELECT *, CASE {place} END AS y FROM (SELECT *, CASE WHEN bucket = {rules.ZERO} THEN 0 ELSE pow({rules.GAMMA!r}::DOUBLE, bucket - 0.5) END AS x FROM g)),
      r AS (SELECT *, sum(n) OVER o AS w, sum(n * y) OVER o AS m, sum(n * y * y) OVER o AS q, sum(n) OVER p AS ws, sum(n * y) OVER p AS ms, sum(n * y * y) OVER p AS qs, lead(bucket) OVER o IS NULL AS last
            FROM y WINDOW p AS (PARTITION BY lang, source, metric), o AS (PARTITION BY lang, source, metric ORDER BY bucket)),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, metric ORDER BY pow(ms * w / ws - m, 2) / (w * (ws - w)) DESC, bucket) AS place FROM r WHERE NOT last) WHERE place = 1),
      c AS (SELECT *, hi - lo >= {rules.APART!r}::DOUBLE * sqrt((greatest(q / w - lo * lo, {spread}) + greatest((qs - q) / (ws - w) - hi * hi, {spread})) / 2) AS apart, metric NOT IN ({two}) OR 2 * (ws - w) <= ws AS upper
            FROM (SELECT *, m / w AS lo, (ms - m) / (ws - w) AS hi FROM best)),
      f AS (SELECT lang, source, {limits} FROM (SELECT lang, source, metric, CASE WHEN apart AND upper THEN bucket END AS high, CASE WHEN apart AND NOT upper THEN bucket + 1 END AS low FROM c) GROUP BY 1, 2)
      SELECT doc_id, {', '.join(rules.STATS)}, base_failed, NOT base_failed AND {fine} AS kept
      FROM s LEFT JOIN f ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source"""


def op1() -> str:
    """All pairs of equal label, and what they reach; vec_id is taken to be unique."""
    return """
      WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
      reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
      n AS (SELECT a, count(*) AS n FROM links GROUP BY 1), low AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
      SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low.b, vec_id) AS component_id, coalesce(vec_id = coalesce(low.b, vec_id), false) AS kept
      FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN low ON vec_id = low.a"""


def op6() -> str:
    """A call's place is its place in a run of turns two apart."""
    json = "'{\"arguments\":{' || CASE WHEN text IS NULL THEN '' ELSE '\"text\":' || to_json(text) || ',' END || '\"turn\":' || turn || '},\"id\":' || to_json(call_id) || ',\"name\":\"reply\"' || coalesce(',\"result\":' || to_json(content), '') || '}'"
    return f"""
      WITH c AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, min(text) AS text, min(text) IS DISTINCT FROM max(text) OR count(text) NOT IN (0, count(*)) AS differ
                 FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
      p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS k FROM c),
      d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, turn - 2 * k ORDER BY turn) - 1 AS depth FROM p),
      r AS (SELECT conv_id || ':' || (turn - 1) AS call_id, count(*) AS n, arg_min(text, turn) AS content FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1)
      SELECT conv_id, turn, call_id, depth, coalesce(n, 0) AS n_results, CASE WHEN text IS NULL THEN 'text: missing' ELSE '' END AS errors,
             CASE WHEN differ THEN 'repeated_id' WHEN text IS NULL THEN 'invalid' WHEN n IS NULL THEN 'no_result' ELSE 'ok' END AS status, {json} AS json FROM d LEFT JOIN r USING (call_id)
      UNION ALL SELECT NULL, NULL, call_id, NULL, n, '', 'orphan', '{{"id":' || to_json(call_id) || coalesce(',"result":' || to_json(content), '') || '}}' FROM r ANTI JOIN d USING (call_id)"""


def op11() -> str:
    """All windows of 13 words, each with the smallest doc_id that has it; doc_id is taken to be unique."""
    return f"""
      WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
      windows AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
      firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
      gone AS (SELECT DISTINCT doc_id, i + o AS i FROM windows JOIN firsts USING (g), unnest(range(13)) AS u(o) WHERE first < doc_id),
      words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
      kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
      SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def op12() -> str:
    """Scores of all documents that share a term with an item; item_id and doc_id are taken to be unique."""
    upper = "".join(map(chr, range(65, 91)))
    found = r"regexp_extract_all(translate(coalesce(text, ''), '" + upper + "', '" + upper.lower() + r"'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
      WITH d AS (SELECT doc_id, {found} AS w FROM documents),
      t AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS total FROM d),
      tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
      df AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, t GROUP BY term),
      q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({found}) AS term FROM benchmark) GROUP BY ALL),
      s AS (SELECT item_id, doc_id, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score FROM q JOIN df USING (term) JOIN tf USING (term), t GROUP BY ALL)
      SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""


def op13() -> str:
    """Every part against every entry, round by round; vec_id is taken to be unique."""
    distance = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // 8) + 1 : (part + 1) * (len(q) // 8)] AS x FROM v, unnest(range(8)) AS u(part))",
        "b0 AS MATERIALIZED (SELECT part, entry, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 16)",
    ]
    for r in range(7):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min({distance} * 16 + entry) AS k FROM p JOIN b{r} USING (part) GROUP BY 1, 2)")
        if r < 6:
            steps.append(f"m{r} AS (SELECT part, k % 16 AS entry, pos, sum(x[pos]) AS s, count(*) AS n FROM a{r}, unnest(range(1, 9)) AS u(pos) GROUP BY ALL)")
            steps.append(f"n{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos)::BIGINT[] AS c FROM m{r} GROUP BY ALL)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN n{r} USING (part, entry))")
    steps.append("e AS (SELECT vec_id, label, string_agg(printf('%02x', k % 16), '' ORDER BY part) AS code, sum(k // 16)::BIGINT AS error FROM a6 JOIN v USING (vec_id) GROUP BY 1, 2)")
    books = "(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b6)"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {books} AS codebooks_sha256 FROM e"
