"""The derived views in the oracle's dialect."""

from __future__ import annotations

VIEWS = {
    "words": """
      SELECT conv_id, turn, role, (k - 1)::BIGINT AS word_idx, ws[k] AS word,
             coalesce(turn_start + list_sum(list_transform(ws[1:k-1], lambda w: 2 + length(w) // 4)), turn_start)::BIGINT AS start_frame,
             (2 + length(ws[k]) // 4)::BIGINT AS n_frames
      FROM (SELECT *, (sum(gap) OVER (PARTITION BY conv_id ORDER BY turn) + sum(len) OVER (PARTITION BY conv_id ORDER BY turn) - len)::BIGINT AS turn_start
            FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 0
                                 ELSE ('0x' || substr(md5(conv_id || ':' || turn), 1, 8))::BIGINT % 11 - 4 END AS gap,
                         coalesce(list_sum(list_transform(ws, lambda w: 2 + length(w) // 4)), 0) AS len
                  FROM (SELECT conv_id, turn, role, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws
                        FROM conversations WHERE role <> 'system'))) t,
           unnest(range(1, len(ws) + 1)) AS u(k)""",
    "segments": "SELECT conv_id, turn, role, min(start_frame) AS start_frame, max(start_frame + n_frames) AS end_frame FROM words GROUP BY ALL",
    "horizon": "SELECT conv_id, max(start_frame + n_frames) AS n_frames FROM words GROUP BY 1",
    "aligned": """
      SELECT s.conv_id, s.frame_idx, CASE WHEN m.word IS NULL THEN 'PAD' ELSE 'WORD' END AS kind, m.word
      FROM (SELECT conv_id, unnest(range(0, n_frames)) AS frame_idx FROM horizon) s
      LEFT JOIN (SELECT conv_id, word, i + max(start_frame - i) OVER (PARTITION BY conv_id ORDER BY i) AS frame_idx
                 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start_frame, turn, word_idx) AS i FROM words WHERE role = 'assistant')) m
      ON s.conv_id = m.conv_id AND s.frame_idx = m.frame_idx""",
    "frames": """
      SELECT conv_id, frame_idx, CASE WHEN kind = 'PAD' AND lead(kind) OVER (PARTITION BY conv_id ORDER BY frame_idx) = 'WORD' THEN 'EPAD' ELSE kind END AS kind, word
      FROM aligned""",
    "codes": """
      SELECT label AS conv_id, frame_idx, k - 1 AS codebook, (floor(abs(embedding[k]::DOUBLE) * 1000)::BIGINT % 2048) AS code
      FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx FROM embeddings), unnest(range(1, 17)) AS u(k)""",
    "delayed": """
      SELECT conv_id, frame_idx + CASE WHEN codebook % 8 > 0 THEN 2 ELSE 0 END AS frame_idx, codebook, code FROM codes
      UNION ALL SELECT conv_id, frame_idx, codebook, 2048 FROM codes WHERE frame_idx < 2 AND codebook % 8 > 0""",
    "code_frames": "SELECT conv_id, frame_idx, list(code ORDER BY codebook) AS codes FROM codes GROUP BY ALL",
    "logits": "SELECT vec_id AS item, label * 6 AS target, k - 1 AS token_id, embedding[k]::DOUBLE AS logit FROM embeddings, unnest(range(1, 65)) AS u(k)",
    "probs": "SELECT *, e / sum(e) OVER (PARTITION BY item) AS p FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY item)) AS e FROM logits)",
    "ranks": "SELECT item, 1 + count(*) FILTER (logit > t) AS rank, max(p) FILTER (token_id = target) AS p FROM (SELECT *, max(logit) FILTER (token_id = target) OVER (PARTITION BY item) AS t FROM probs) GROUP BY item",
    "generations": """
      SELECT lang AS probe, CASE doc_id % 4 WHEN 0 THEN 'chatml' WHEN 1 THEN 'open' WHEN 2 THEN 'open_pad' ELSE 'no_markers' END AS condition,
             doc_id % 3 AS seed, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE text END AS text FROM documents""",
    "signal": "SELECT user_id AS session, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'assistant' ELSE 'user' END AS role, event_id, epoch_us(ts) AS micros, value FROM events",
    "pairs": """
      SELECT conv_id, turn, text AS prompt, reply FROM (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      WHERE role = 'user' AND r2 = 'assistant'""",
    "units": """
      SELECT conv_id, CASE WHEN n = 1 THEN 'isolated' WHEN n = 2 AND roles = 2 THEN 'single_turn' ELSE 'multi_turn' END AS structure
      FROM (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles FROM conversations WHERE role <> 'system' GROUP BY 1)""",
    "halves": """
      SELECT a.vec_id AS row_id, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0""",
    "pool": "SELECT vec_id AS voice, row_number() OVER (ORDER BY ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT, vec_id) - 1 AS slot FROM embeddings WHERE label = 0",
    "voices": """
      SELECT sample_id, CASE WHEN v.voice <> own_voice THEN v.voice WHEN v2.voice <> own_voice THEN v2.voice END AS voice
      FROM (SELECT conv_id || ':' || turn AS sample_id, conv_id % 50 AS own_voice, ('0x' || substr(md5(conv_id || ':' || turn || ':1'), 1, 8))::BIGINT % (SELECT count(*) FROM pool) AS slot FROM pairs) s
      JOIN pool v ON v.slot = s.slot JOIN pool v2 ON v2.slot = (s.slot + 1) % (SELECT count(*) FROM pool)""",
    "zoned": "SELECT *, CASE WHEN frame_idx < 6 THEN 'A' WHEN frame_idx < 50 THEN 'B' ELSE 'C' END AS zone FROM frames",
    "weighted": """
      SELECT *, CASE WHEN zone = 'A' THEN 0.0::DOUBLE WHEN kind = 'PAD' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END
             * CASE WHEN (kind = 'WORD') <> coalesce(lag(kind) OVER (PARTITION BY conv_id ORDER BY frame_idx) = 'WORD', kind = 'WORD') THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM zoned""",
}
NEEDS = {
    "segments": ["words"], "horizon": ["words"], "aligned": ["words", "horizon"], "frames": ["aligned"], "delayed": ["codes"], "code_frames": ["codes"], "probs": ["logits"],
    "ranks": ["probs"], "voices": ["pairs", "pool"], "zoned": ["frames"], "weighted": ["zoned"],
}


def with_views(query: str, *names: str) -> str:
    """``query`` after the definitions of the views it names, and of those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return ("WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order) + " " if order else "") + query
