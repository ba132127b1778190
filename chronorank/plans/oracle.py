"""SQL counterparts of the registered queries.

They spell the formulas out directly, term by term and for every topic, where
the operators use decomposed or in-row forms, so the two sides are independent.
"""

from __future__ import annotations

import re

from chronorank.operators import loading as LD
from chronorank.operators.routing import SIZE_LIMIT
from chronorank.plans import jobs
from chronorank.plans.corpus import NUGGETS_PER_TOPIC, SENTENCE, STOP
from chronorank.functions.text import NON_SPACE, WORD

MU = 2500
STOPPED = ", ".join(f"'{t}'" for t in STOP)
SENTENCE_SQL = SENTENCE.replace("\\n", "\n")


def _tokens(text: str) -> str:
    return f"unnest(regexp_extract_all(lower({text}), '{WORD}'))"


RELATIONS: dict[str, str] = {
    "docs": "SELECT doc_id, source, text AS clean_visible FROM documents",
    "captures": """
        SELECT event_id AS doc_id,
               concat(CAST(epoch_us(ts) // 1000000 AS VARCHAR), '-', md5(CAST(event_id AS VARCHAR))) AS stream_id,
               epoch_us(ts) // 1000 AS epoch_ms,
               strftime(ts, '%Y-%m-%d-%H') AS hour,
               strftime(ts, '%Y-%m-%dT%H:%M:%S.')
                 || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS zulu
        FROM events""",
    "items": "SELECT * FROM docs JOIN captures USING (doc_id)",
    "topic_table": "SELECT CAST(item_id + 1 AS INTEGER) AS query_id, text AS query FROM benchmark",
    "topic_tokens": f"SELECT query_id, {_tokens('query')} AS term FROM topic_table",
    "topic_terms": """
        SELECT query_id, term, CAST(count(*) AS DOUBLE) AS w FROM topic_tokens GROUP BY ALL""",
    "topic_ids": """
        SELECT t.query_id, CAST(count(k.term) AS DOUBLE) AS qlen
        FROM topic_table t LEFT JOIN topic_tokens k USING (query_id) GROUP BY ALL""",
    "stopped_topic_terms": f"SELECT * FROM topic_terms WHERE term NOT IN ({STOPPED})",
    "stopped_topic_ids": """
        SELECT t.query_id, coalesce(sum(k.w), 0) AS qlen
        FROM topic_table t LEFT JOIN stopped_topic_terms k USING (query_id) GROUP BY ALL""",
    "bins": """
        SELECT DISTINCT strftime(ts, '%Y-%m-%d-%H') AS hour,
               CAST(date_diff('hour', (SELECT date_trunc('hour', min(ts)) FROM events), date_trunc('hour', ts))
                    AS INTEGER) AS bin
        FROM events""",
    "doc_tokens": f"SELECT doc_id, {_tokens('clean_visible')} AS term FROM docs",
    "terms": "SELECT doc_id, term, count(*) AS tf FROM doc_tokens GROUP BY ALL",
    "lengths": """
        SELECT d.doc_id, coalesce(CAST(sum(t.tf) AS BIGINT), 0) AS length
        FROM docs d LEFT JOIN terms t USING (doc_id) GROUP BY ALL""",
    "stopped_terms": f"SELECT * FROM terms WHERE term NOT IN ({STOPPED})",
    "stopped_lengths": """
        SELECT d.doc_id, coalesce(CAST(sum(t.tf) AS BIGINT), 0) AS length
        FROM docs d LEFT JOIN stopped_terms t USING (doc_id) GROUP BY ALL""",
    "vocab": "SELECT term, CAST(sum(tf) AS DOUBLE) AS cf FROM terms GROUP BY term",
    "total": "SELECT sum(cf) AS total FROM vocab",
    "background": "SELECT term, cf / total AS cp FROM vocab, total",
    "topic_cp": """
        SELECT t.query_id, t.term, t.w, coalesce(b.cp, 1 / total) AS cp
        FROM topic_terms t LEFT JOIN background b USING (term), total""",
    # the document as query, each topic as text, relative to the collection model
    "margins": f"""
        SELECT d.doc_id, q.query_id, round(coalesce(sum(
                 t.tf * ln((coalesce(k.w, 0) + {MU} * b.cp) / (q.qlen + {MU}) / b.cp)), 0), 9) AS margin
        FROM docs d CROSS JOIN topic_ids q
        LEFT JOIN terms t ON t.doc_id = d.doc_id
        LEFT JOIN background b ON b.term = t.term
        LEFT JOIN topic_terms k ON k.query_id = q.query_id AND k.term = t.term
        GROUP BY d.doc_id, q.query_id""",
    "routed": """
        SELECT doc_id, query_id, margin FROM margins
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY margin DESC, query_id) = 1""",
    "stored": """
        SELECT r.query_id, coalesce(b.bin, -1) AS date_bin,
               printf('%02d%04d.%s', r.query_id, b.bin, i.stream_id) AS rowkey,
               i.*
        FROM items i JOIN routed r USING (doc_id) LEFT JOIN bins b USING (hour)""",
    "kl_plain": f"""
        SELECT s.query_id, s.stream_id, s.doc_id, l.length,
               sum(q.w * ln((coalesce(t.tf, 0) + {MU} * q.cp) / (l.length + {MU}))) AS score
        FROM stored s JOIN lengths l USING (doc_id) JOIN topic_cp q USING (query_id)
        LEFT JOIN terms t ON t.doc_id = s.doc_id AND t.term = q.term GROUP BY ALL""",
    "kl_first": f"""
        SELECT s.query_id, s.stream_id, s.doc_id, l.length,
               sum(q.w * ln((coalesce(t.tf, 0) + {MU} * q.cp) / (l.length + {MU}))) AS score
        FROM stored s JOIN stopped_lengths l USING (doc_id) JOIN topic_cp q USING (query_id)
        LEFT JOIN stopped_terms t ON t.doc_id = s.doc_id AND t.term = q.term GROUP BY ALL""",
    "first_ranks": """
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, stream_id)
                       AS BIGINT) AS rank
        FROM kl_first""",
    "feedback": """
        SELECT *, exp(score - max(score) OVER (PARTITION BY query_id)) AS doc_weight,
               count(*) OVER (PARTITION BY query_id) AS n_docs
        FROM first_ranks WHERE rank <= 20 AND length > 0""",
    "relevance_raw": """
        SELECT query_id, term, sum(tf / length * doc_weight) / any_value(n_docs) AS raw
        FROM feedback JOIN stopped_terms USING (doc_id) GROUP BY query_id, term""",
    "relevance_ranked": """
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, term) AS BIGINT) AS rank
        FROM relevance_raw""",
    "relevance": """
        SELECT query_id, term, rank, raw / sum(raw) OVER (PARTITION BY query_id) AS weight
        FROM relevance_ranked WHERE rank <= 20""",
    "expanded": """
        SELECT query_id, term, 0.5 * coalesce(q.w, 0) + 0.5 * coalesce(r.weight, 0) AS w
        FROM topic_terms q FULL JOIN relevance r USING (query_id, term)""",
    "expanded_cp": """
        SELECT e.query_id, e.term, e.w, coalesce(b.cp, 1 / total) AS cp
        FROM expanded e LEFT JOIN background b USING (term), total""",
    "rescored": f"""
        SELECT s.query_id, s.stream_id, s.rank AS first_rank,
               sum(q.w * ln((coalesce(t.tf, 0) + {MU} * q.cp) / (s.length + {MU}))) AS score
        FROM first_ranks s JOIN expanded_cp q USING (query_id)
        LEFT JOIN stopped_terms t ON t.doc_id = s.doc_id AND t.term = q.term GROUP BY ALL""",
    "cut": f"""
        SELECT doc_id, stream_id,
               list_filter(regexp_extract_all(clean_visible, '{SENTENCE_SQL}'),
                           lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS l
        FROM items""",
    "sentences": f"""
        SELECT doc_id, stream_id, CAST(u.i - 1 AS INTEGER) AS sent_num,
               array_to_string(list_transform(regexp_extract_all(l[u.i], '{NON_SPACE}'), lambda x: x || ' '), '')
                 AS sentence
        FROM cut, LATERAL (SELECT unnest(range(1, len(cut.l) + 1)) AS i) u""",
    "sent_tokens": f"SELECT doc_id, sent_num, {_tokens('sentence')} AS term FROM sentences",
    "sent_terms": "SELECT doc_id, sent_num, term, count(*) AS tf FROM sent_tokens GROUP BY ALL",
    "sent_lengths": """
        SELECT s.doc_id, s.sent_num, coalesce(sum(t.tf), 0) AS length
        FROM sentences s LEFT JOIN sent_terms t USING (doc_id, sent_num) GROUP BY ALL""",
    # the three granularities: sentence, beginning and document
    "units": """
        SELECT doc_id, sent_num AS unit, term, tf FROM sent_terms
        UNION ALL SELECT doc_id, -1, term, sum(tf) FROM sent_terms WHERE sent_num < 20 GROUP BY ALL
        UNION ALL SELECT doc_id, -2, term, sum(tf) FROM sent_terms GROUP BY ALL""",
    "unit_lengths": """
        SELECT doc_id, sent_num AS unit, length FROM sent_lengths
        UNION ALL SELECT doc_id, -1, sum(length) FROM sent_lengths WHERE sent_num < 20 GROUP BY doc_id
        UNION ALL SELECT doc_id, -2, sum(length) FROM sent_lengths GROUP BY doc_id""",
    "unit_scores": f"""
        SELECT s.query_id, s.doc_id, l.unit, l.length,
               sum(q.w * ln((coalesce(t.tf, 0) + {MU} * q.cp) / (l.length + {MU}))) AS score
        FROM stored s JOIN unit_lengths l USING (doc_id) JOIN topic_cp q USING (query_id)
        LEFT JOIN units t ON t.doc_id = s.doc_id AND t.unit = l.unit AND t.term = q.term GROUP BY ALL""",
    "n_sentences": "SELECT doc_id, count(*) AS n_sent FROM sentences GROUP BY doc_id",
    "query_top": """
        SELECT query_id, sum(w) AS qlen, max(cp) AS cp FROM topic_cp GROUP BY query_id""",
    "length_bounds": f"""
        SELECT x.query_id, x.length,
               sum(q.w * ln({MU} * q.cp / (x.length + {MU}))) AS min_score,
               any_value(m.qlen) * ln((x.length + {MU} * any_value(m.cp)) / (x.length + {MU})) AS max_score,
               sum(q.w * ln((10 + {MU} * q.cp) / (x.length + {MU}))) AS practical_score
        FROM (SELECT DISTINCT query_id, length FROM lengths JOIN stored USING (doc_id)
              UNION SELECT DISTINCT query_id, CAST(length AS BIGINT) FROM unit_lengths JOIN stored USING (doc_id)
              WHERE unit = -2) x
        JOIN topic_cp q USING (query_id) JOIN query_top m USING (query_id)
        GROUP BY x.query_id, x.length""",
    "sentence_rows": """
        SELECT s.query_id, s.epoch_ms // 1000 AS epoch, s.source, s.rowkey, s.stream_id,
               CAST(u.unit AS INTEGER) AS sent_num, d.score AS doc_score, t.score AS top_score,
               u.score AS sent_score, CAST(n.n_sent AS INTEGER) AS n_sent, CAST(d.length AS BIGINT) AS doc_len,
               b.min_score, b.max_score, b.practical_score
        FROM stored s
        JOIN unit_scores u ON u.doc_id = s.doc_id AND u.unit >= 0
        JOIN unit_scores t ON t.doc_id = s.doc_id AND t.unit = -1
        JOIN unit_scores d ON d.doc_id = s.doc_id AND d.unit = -2
        JOIN n_sentences n ON n.doc_id = s.doc_id
        JOIN length_bounds b ON b.query_id = s.query_id AND b.length = d.length""",
    "out": """
        SELECT query_id, stream_id AS docid, sent_num AS sentenceid, doc_score AS docscore,
               sent_score AS sentencescore, epoch,
               concat(stream_id, '-', CAST(sent_num AS VARCHAR)) AS updateid
        FROM sentence_rows""",
    "pooled": """
        SELECT concat(s.stream_id, '-', CAST(s.sent_num AS VARCHAR)) AS updateid, s.*, l.quality
        FROM sentences s JOIN labels l USING (doc_id)""",
    "matches": f"""
        SELECT updateid,
               concat('N', CAST(query AS VARCHAR), '.',
                      CAST((doc_id * 7 + sent_num) % {NUGGETS_PER_TOPIC} AS VARCHAR)) AS nuggetid,
               query, 0 AS "start", CAST(length(sentence) AS INTEGER) AS "end"
        FROM (SELECT *, CAST(doc_id % (SELECT count(*) FROM benchmark) + 1 AS INTEGER) AS query
              FROM pooled WHERE quality = 1)""",
    "nuggets": f"""
        SELECT query_id AS query, concat('N', CAST(query_id AS VARCHAR), '.', CAST(k AS VARCHAR)) AS nuggetid,
               CAST(k % 5 - 1 AS INTEGER) AS score,
               CAST(1704067200 + 3600 * (query_id * {NUGGETS_PER_TOPIC} + k) AS BIGINT) AS epoch
        FROM topic_table, range(0, {NUGGETS_PER_TOPIC}) r(k)""",
    "judged": """
        SELECT o.*, n.score FROM out o JOIN matches m USING (updateid) JOIN nuggets n USING (nuggetid)""",
    "matched_epochs": """
        SELECT m.nuggetid, m.query, o.docid, o.sentenceid, m."start", m."end", o.epoch AS sentence_epoch,
               o.docscore, o.sentencescore, n.epoch AS nugget_epoch, n.score
        FROM out o JOIN matches m USING (updateid)
        JOIN nuggets n ON n.nuggetid = m.nuggetid AND n.query = m.query""",
    "external_tokens": f"SELECT {_tokens('text')} AS term FROM conversations",
    "external_vocab": "SELECT term, CAST(count(*) AS DOUBLE) AS cf FROM external_tokens GROUP BY term",
    "external_total": "SELECT sum(cf) AS total FROM external_vocab",
    "dump_query": f"""
        SELECT t.term, t.w, coalesce(v.cf, 1) / total AS cp
        FROM topic_terms t LEFT JOIN external_vocab v USING (term), external_total
        WHERE t.query_id = {jobs.DUMP_QUERY}""",
    "dump_scores": f"""
        SELECT l.doc_id, l.unit,
               sum(q.w * ln((coalesce(t.tf, 0) + {MU} * q.cp) / (l.length + {MU}))) AS score
        FROM unit_lengths l CROSS JOIN dump_query q
        LEFT JOIN units t ON t.doc_id = l.doc_id AND t.unit = l.unit AND t.term = q.term GROUP BY ALL""",
    "add_one_margins": f"""
        SELECT d.doc_id, q.query_id, round(coalesce(sum(
                 t.tf * ln((coalesce(k.w, 0) + {MU} * (1 + v.cf) / total) / (q.qlen + {MU})
                           / ((1 + v.cf) / total))), 0), 9) AS margin
        FROM docs d CROSS JOIN stopped_topic_ids q CROSS JOIN total
        LEFT JOIN stopped_terms t ON t.doc_id = d.doc_id
        LEFT JOIN vocab v ON v.term = t.term
        LEFT JOIN stopped_topic_terms k ON k.query_id = q.query_id AND k.term = t.term
        GROUP BY d.doc_id, q.query_id""",
    "add_one": """
        SELECT doc_id, query_id, margin FROM add_one_margins
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY margin DESC, query_id) = 1""",
    "kl_pairs": f"""
        SELECT l.doc_id, i.query_id, any_value(l.length) AS length,
               coalesce(sum(q.w * ln((coalesce(t.tf, 0) + {MU} * q.cp) / (l.length + {MU}))), 0) AS score
        FROM lengths l CROSS JOIN topic_ids i LEFT JOIN topic_cp q USING (query_id)
        LEFT JOIN terms t ON t.doc_id = l.doc_id AND t.term = q.term
        GROUP BY l.doc_id, i.query_id""",
    "route_pairs": f"""
        SELECT l.doc_id, q.query_id, any_value(l.length) AS length,
               coalesce(sum(t.tf * ln({MU} * b.cp)), 0) AS doc_constant,
               coalesce(sum(t.tf * ln((coalesce(k.w, 0) + {MU} * b.cp) / (q.qlen + {MU}))), 0) AS score
        FROM lengths l CROSS JOIN topic_ids q
        LEFT JOIN terms t ON t.doc_id = l.doc_id
        LEFT JOIN background b ON b.term = t.term
        LEFT JOIN topic_terms k ON k.query_id = q.query_id AND k.term = t.term
        GROUP BY l.doc_id, q.query_id""",
    "words": f"SELECT doc_id, unnest(regexp_extract_all(clean_visible, '{NON_SPACE}')) AS word FROM docs",
    "path_parts": "SELECT stream_id, replace(stream_id, '-', '') AS bare_id FROM captures",
}

# feedback and rerank again, from the first ranks within a query's hours on
RELATIONS["hour_items"] = f"""
        SELECT doc_id FROM stored
        WHERE query_id = {jobs.SCAN_QUERY} AND date_bin >= {jobs.SCAN_LOW} AND date_bin < {jobs.SCAN_HIGH}"""
FEEDBACK = [
    "first_ranks", "feedback", "relevance_raw", "relevance_ranked", "relevance", "expanded", "expanded_cp", "rescored"
]
for _name in FEEDBACK:
    _sql = re.sub(rf"\b({'|'.join(FEEDBACK)})\b", r"hour_\1", RELATIONS[_name])
    RELATIONS[f"hour_{_name}"] = _sql.replace("FROM kl_first", "FROM kl_first JOIN hour_items USING (doc_id)")

STORED = "query_id, date_bin, rowkey, stream_id, epoch_ms, source"

BODIES: dict[str, str] = {
    "scan_items": f"SELECT {STORED}, clean_visible FROM stored",
    "scan_bins": f"""SELECT {STORED} FROM stored WHERE query_id = {jobs.SCAN_QUERY}
        AND date_bin >= {jobs.SCAN_LOW} AND date_bin < {jobs.SCAN_HIGH}""",
    "scan_query": f"SELECT {STORED} FROM stored WHERE query_id = {jobs.SCAN_QUERY}",
    "lookup_items": f"""SELECT {STORED}, clean_visible FROM stored
        WHERE doc_id IN (SELECT doc_id FROM first_ranks WHERE rank <= 20)""",
    "topics": "SELECT query_id, term, w, qlen FROM topic_terms JOIN topic_ids USING (query_id)",
    "date_bins": "SELECT hour, bin FROM bins",
    "valid_items": """SELECT stream_id, source, clean_visible FROM captures JOIN docs USING (doc_id)
        WHERE length(clean_visible) > 0""",
    "size_filter": f"""SELECT stream_id, CAST(strlen(clean_visible) AS BIGINT) AS n_bytes,
        strlen(clean_visible) < {jobs.SMALL_LIMIT} AS accepted FROM items""",
    "item_times": "SELECT stream_id, epoch_ms, hour FROM captures",
    "sentences": "SELECT stream_id, sent_num, sentence FROM sentences",
    "update_ids": """SELECT stream_id, sent_num, concat(stream_id, '-', CAST(sent_num AS VARCHAR)) AS updateid
        FROM sentences""",
    "id_shards": """SELECT stream_id, array_to_string(regexp_extract_all(bare_id, '.{1,2}'), '/') AS path, bare_id
        FROM path_parts""",
    "trec_export": """
        SELECT i.stream_id, i.hour AS hourdaydir,
               concat('<DOC>\n<DOCNO>', i.stream_id, '</DOCNO>\n<SOURCE>', i.source, '</SOURCE>\n<URL>',
                      coalesce(p.url, ''), '</URL>\n<DATETIME>', i.zulu, '</DATETIME>\n<HOURDAYDIR>', i.hour,
                      '</HOURDAYDIR>\n<EPOCH>', CAST(i.epoch_ms AS VARCHAR), '</EPOCH>\n<TEXT>\n',
                      coalesce(s.lines, ''), '\n</TEXT>\n</DOC>\n') AS record
        FROM items i
        LEFT JOIN pages p ON p.page_id = i.doc_id
        LEFT JOIN (SELECT doc_id, string_agg(concat(CAST(sent_num AS VARCHAR), ' ', sentence, '\n'), ''
                                             ORDER BY sent_num) AS lines
                   FROM sentences GROUP BY doc_id) s ON s.doc_id = i.doc_id""",
    "doc_terms": "SELECT doc_id, term, tf FROM terms",
    "doc_terms_stopped": "SELECT doc_id, term, tf FROM stopped_terms",
    "doc_lengths": """SELECT l.doc_id, l.length, s.length AS stopped_length
        FROM lengths l JOIN stopped_lengths s USING (doc_id)""",
    "word_count": "SELECT word, count(*) AS n FROM words GROUP BY word",
    "word_count_stored": "SELECT word, count(*) AS n FROM words GROUP BY word",
    "word_count_ids": """SELECT word, count(*) AS n FROM words
        WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY word""",
    "row_count": "SELECT 'all' AS key, count(*) AS n FROM docs JOIN captures USING (doc_id)",
    "collection_stats": "SELECT term, cf AS weight FROM vocab",
    "collection_total": "SELECT total FROM total",
    "kl_scores": """
        SELECT doc_id, query_id, length, round(score, 6) AS score,
               CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, query_id) AS BIGINT) AS rank
        FROM kl_pairs""",
    "kl_scores_routed": "SELECT query_id, stream_id, length, round(score, 6) AS score FROM kl_plain",
    "cer_scores": f"""
        SELECT s.query_id, s.stream_id, l.length,
               round(sum(q.w / m.qlen * ln((coalesce(t.tf, 0) + {MU} * q.cp) / (l.length + {MU}) / q.cp)), 6) AS score
        FROM stored s JOIN lengths l USING (doc_id) JOIN topic_cp q USING (query_id)
        JOIN topic_ids m USING (query_id)
        LEFT JOIN terms t ON t.doc_id = s.doc_id AND t.term = q.term GROUP BY ALL""",
    "maxest_scores": f"""
        SELECT s.query_id, s.stream_id, l.length,
               round(sum(q.w * ln((1 + {MU} * q.cp) / (l.length + {MU}))), 6) AS score
        FROM stored s JOIN lengths l USING (doc_id) JOIN topic_cp q USING (query_id) GROUP BY ALL""",
    "score_bounds": """
        SELECT s.query_id, s.stream_id, l.length, round(b.min_score, 6) AS min_score,
               round(b.max_score, 6) AS max_score, round(b.practical_score, 6) AS practical_score
        FROM stored s JOIN lengths l USING (doc_id)
        JOIN length_bounds b ON b.query_id = s.query_id AND b.length = l.length""",
    "rank_docs": """
        SELECT query_id, stream_id, round(score, 6) AS score,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, stream_id) AS BIGINT) AS rank
        FROM kl_plain""",
    "route_scores": """
        SELECT doc_id, query_id, length, round(doc_constant, 3) AS doc_constant, round(score, 3) AS score,
               CAST(row_number() OVER (PARTITION BY doc_id ORDER BY margin DESC, query_id) AS BIGINT) AS rank
        FROM route_pairs JOIN margins USING (doc_id, query_id)""",
    "route": "SELECT stream_id, query_id, round(margin, 6) AS margin FROM routed JOIN captures USING (doc_id)",
    "route_add_one": """
        SELECT stream_id, query_id, round(margin, 6) AS margin FROM add_one JOIN captures USING (doc_id)""",
    "route_assignments": "SELECT stream_id, query_id FROM routed JOIN captures USING (doc_id)",
    "route_load": f"SELECT {STORED}, hour, clean_visible FROM stored",
    "rejected_items": f"""
        SELECT c.stream_id, d.source, CAST(strlen(d.clean_visible) AS BIGINT) AS n_bytes,
               CASE WHEN d.doc_id IS NULL THEN '{LD.NO_BODY}'
                    WHEN coalesce(length(d.clean_visible), 0) = 0 THEN '{LD.NO_TEXT}'
                    ELSE '{LD.TOO_LARGE}' END AS reason
        FROM captures c LEFT JOIN docs d USING (doc_id)
        WHERE coalesce(length(d.clean_visible), 0) = 0 OR strlen(d.clean_visible) >= {SIZE_LIMIT}""",
    "feedback_docs": """
        SELECT query_id, stream_id, length, round(score, 6) AS score, rank FROM first_ranks WHERE rank <= 20""",
    "rm_terms": "SELECT query_id, term, rank, round(weight, 8) AS weight FROM relevance",
    "rm3_model": "SELECT query_id, term, round(w, 8) AS w FROM expanded",
    "rm3_rerank": """
        SELECT query_id, stream_id, round(score, 6) AS score,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, stream_id) AS BIGINT) AS rank
        FROM rescored""",
    "rm3_rerank_hours": """
        SELECT query_id, stream_id, round(score, 6) AS score,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, stream_id) AS BIGINT) AS rank
        FROM hour_rescored""",
    "rm3_rerank_top1000": """
        SELECT query_id, stream_id, round(score, 6) AS score,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, stream_id) AS BIGINT) AS rank
        FROM rescored WHERE first_rank <= 1000""",
    "rm3_rerank_shallow": f"""
        SELECT query_id, stream_id, round(score, 6) AS score,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, stream_id) AS BIGINT) AS rank
        FROM rescored WHERE first_rank <= {jobs.SHALLOW_DEPTH}""",
    "sentence_scores": """
        SELECT query_id, epoch, source, rowkey, stream_id, sent_num, round(doc_score, 6) AS doc_score,
               round(top_score, 6) AS top_score, round(sent_score, 6) AS sent_score, n_sent, doc_len,
               round(min_score, 6) AS min_score, round(max_score, 6) AS max_score,
               round(practical_score, 6) AS practical_score
        FROM sentence_rows""",
    "sentence_dump": """
        SELECT 'documents' AS path, i.source, i.epoch_ms, i.stream_id, round(d.score, 6) AS doc_score, s.sent_num,
               round(u.score, 6) AS sent_score, s.sentence
        FROM items i JOIN sentences s USING (doc_id)
        JOIN dump_scores d ON d.doc_id = i.doc_id AND d.unit = -2
        JOIN dump_scores u ON u.doc_id = i.doc_id AND u.unit = s.sent_num""",
    "latest_sentence": """
        SELECT query_id, stream_id, sent_num, epoch, source, rowkey, round(doc_score, 6) AS doc_score,
               round(top_score, 6) AS top_score, round(sent_score, 6) AS sent_score, n_sent, doc_len,
               round(min_score, 6) AS min_score, round(max_score, 6) AS max_score,
               round(practical_score, 6) AS practical_score
        FROM sentence_rows
        QUALIFY row_number() OVER (PARTITION BY query_id, stream_id ORDER BY sent_num DESC) = 1""",
    "match_scores": """
        SELECT o.updateid, o.query_id, o.docid, o.sentenceid, round(o.docscore, 6) AS docscore,
               round(o.sentencescore, 6) AS sentencescore, o.epoch, m.nuggetid, m.query, m."start", m."end"
        FROM out o JOIN matches m USING (updateid)""",
    "doc_vs_nugget": """
        SELECT query_id, score, round(avg(docscore), 6) AS meandoc FROM judged GROUP BY query_id, score""",
    "sent_vs_nugget": """
        SELECT query_id, score, round(avg(sentencescore), 6) AS meansent FROM judged GROUP BY query_id, score""",
    "sentence_position": """
        SELECT query_id, sentenceid, round(avg(sentencescore), 6) AS mean FROM out
        GROUP BY query_id, sentenceid""",
    "sentence_position_nugget": """
        SELECT query_id, sentenceid, round(avg(score), 6) AS mean FROM judged
        GROUP BY query_id, sentenceid""",
    "doc_score_by_time": """
        SELECT query_id, epoch, round(avg(docscore), 6) AS mean, round(abs(avg(docscore)), 6) AS magnitude
        FROM out GROUP BY query_id, epoch""",
    "nonmatch_pooled": """
        SELECT query_id, docid, sentenceid, round(docscore, 6) AS docscore,
               round(sentencescore, 6) AS sentencescore, epoch, updateid
        FROM out o WHERE EXISTS (SELECT 1 FROM pooled p WHERE p.updateid = o.updateid)
          AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.updateid = o.updateid)""",
    "nonmatch_all": """
        SELECT query_id, docid, sentenceid, round(docscore, 6) AS docscore,
               round(sentencescore, 6) AS sentencescore, epoch, updateid
        FROM out o WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.updateid = o.updateid)""",
    "match_vs_nonmatch": """
        SELECT 'matches' AS rows, round(avg(docscore), 6) AS mean_doc_score,
               round(avg(sentencescore), 6) AS mean_sent_score FROM matched_epochs WHERE score >= 0
        UNION ALL
        SELECT 'nonmatches_pooled', round(avg(docscore), 6), round(avg(sentencescore), 6)
        FROM out o WHERE EXISTS (SELECT 1 FROM pooled p WHERE p.updateid = o.updateid)
          AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.updateid = o.updateid)
        UNION ALL
        SELECT 'nonmatches_all', round(avg(docscore), 6), round(avg(sentencescore), 6)
        FROM out o WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.updateid = o.updateid)""",
    "nugget_epochs": """
        SELECT nuggetid, query, docid, sentenceid, "start", "end", sentence_epoch, round(docscore, 6) AS docscore,
               round(sentencescore, 6) AS sentencescore, nugget_epoch, score
        FROM matched_epochs""",
    "nugget_score_by_time": """
        SELECT n.epoch, round(avg(n.score), 6) AS meanscore
        FROM matches m JOIN nuggets n ON n.query = m.query AND n.nuggetid = m.nuggetid
        WHERE n.score >= 0 GROUP BY n.epoch""",
}


def _with(body: str) -> str:
    """``body`` behind the relations it uses, in definition order."""
    names = list(RELATIONS)
    needed: set[str] = set()

    def visit(text: str, self_name: str | None = None) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+([a-z_]+)\b", text):
            if name in RELATIONS and name not in needed and name != self_name:
                needed.add(name)
                visit(RELATIONS[name], name)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in names if n in needed)
    return f"WITH {parts}\n{body}"


def oracle_sql() -> dict[str, str]:
    return {name: _with(BODIES[name]) for name in jobs.JOBS if name in BODIES}
