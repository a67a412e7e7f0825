"""Registered queries: filing text, chunks, similarity, extraction inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as tx
from ..session import cut_lineage
from ..sources import bench as bv
from .catalog import query, rounded, tidy
from .oracle_views import VIEWS

# --- D1-D9: parsing ---------------------------------------------------------------------------------------------


_TAG = r"""(?:[^>"'']|"[^"]*"|''[^'']*'')*"""
_D1 = rf"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b{_TAG}>.*?(?:</script\s*>|\z)|<style\b{_TAG}>.*?(?:</style\s*>|\z)|<noscript\b{_TAG}>.*?(?:</noscript\s*>|\z)', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '(?is)</?(?:p|div|br|tr|li|section|article|h1|h2|h3|h4|h5|h6)\b{_TAG}>', chr(10), 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t, '(?is)</?[a-z]{_TAG}>|<[!?][^>]*>', '', 'g') AS t FROM b),
d AS (SELECT page_id, replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(replace(t, '&middot;', chr(183)), '&copy;?', chr(169), 'g'), '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '&nbsp;', chr(160)) AS t FROM c)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n[\s]*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM d"""


@query("d1_html_to_text", _D1)
def d1(spark, sf):
    return tx.html_to_text(bv.spread(bv.table(spark, sf, "pages"), "page_id").select("page_id", "html"), "html").select("page_id", "text")


# The headings as SQL, written out: the query must not read the tables it is held against.
_HEADINGS = [
    ("Business", r"^\s*(item\s*1\.?\s*)?business\s*$"),
    ("Risk Factors", r"^\s*(item\s*1a\.?\s*)?risk\s*factors\s*$"),
    ("Unresolved Staff Comments", r"^\s*(item\s*1b\.?\s*)?unresolved\s*staff\s*comments\s*$"),
    ("Properties", r"^\s*(item\s*2\.?\s*)?properties\s*$"),
    ("Legal Proceedings", r"^\s*(item\s*3\.?\s*)?legal\s*proceedings\s*$"),
    ("Market for Registrant''s Common Equity", r"^\s*(item\s*5\.?\s*)?market\s*for\s*registrant[''’]s\s*common\s*equity\s*$"),
    ("Selected Financial Data", r"^\s*(item\s*6\.?\s*)?selected\s*financial\s*data\s*$"),
    ("Management''s Discussion and Analysis", r"^\s*md&a\s*$|^\s*item\s*7\.?\s*management[''’]s\s*discussion\s*and\s*analysis(\s*of\s*financial\s*condition\s*and\s*results\s*of\s*operations)?\s*$"
                                              r"|^\s*management[''’]s\s+discussion\s+and\s+analysis(\s*of\s*financial\s*condition\s*and\s*results\s*of\s*operations)?\s*$"),
    ("Quantitative and Qualitative Disclosures About Market Risk", r"^\s*(item\s*7a\.?\s*)?quantitative\s*and\s*qualitative\s*disclosures\s*about\s*market\s*risk\s*$"),
    ("Financial Statements", r"^\s*(item\s*8\.?\s*|consolidated\s*)?financial\s*statements\s*$"),
    ("Notes to Financial Statements", r"^\s*notes\s*to\s*(consolidated\s*)?financial\s*statements\s*$"),
    ("Market Risk", r"^\s*(item\s*7a\.?\s*)?market\s*risk\s*$"),
]


def _class_sql(line: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({line}), '{pattern}') THEN '{name}'" for name, pattern in _HEADINGS)
    return f"CASE WHEN length({line}) = 0 OR length({line}) > 180 THEN NULL {cases} END"


VIEWS["doc_lines"] = r"""
SELECT doc_id, i, trim(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM filing_texts)"""
VIEWS["doc_heads"] = f"""
WITH c AS (SELECT doc_id, i, line, {_class_sql('line')} AS section FROM doc_lines),
t AS (SELECT h.doc_id, h.i, h.section, (SELECT arg_min(l.line, l.i) FROM doc_lines l WHERE l.doc_id = h.doc_id AND l.i > h.i AND l.i <= h.i + 10 AND l.line <> '') AS nxt FROM c h WHERE section IS NOT NULL)
SELECT doc_id, i, section, coalesce(regexp_full_match(nxt, '[0-9]{{1,4}}'), false) AS toc FROM t"""


@query("d3_d4_headings", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, section, toc FROM doc_heads")
def d3(spark, sf):
    """Title-like lines of every filing with their section and whether they sit in a table of contents."""
    d = bv.filing_texts(spark, sf).select("doc_id", F.split("text", tx.LINE_BREAK).alias("lines"))
    found = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), tx.classify_section(x).alias("section"))), lambda h: h["section"].isNotNull())
    d = d.withColumn("h", found).select("doc_id", "lines", F.inline("h"))
    return d.select("doc_id", "line_no", "section", tx._toc_row(F.col("lines"), F.col("line_no")).alias("toc"))


VIEWS["doc_sections"] = r"""
WITH f AS (SELECT * FROM doc_heads WHERE NOT toc QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY i) = 1),
n AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM filing_texts),
b AS (SELECT n.doc_id, n.section, regexp_replace(string_agg(r.line, chr(10) ORDER BY r.i), '^\s+|\s+$', '', 'g') AS body FROM n JOIN raw r ON r.doc_id = n.doc_id AND r.i > n.i AND (nx IS NULL OR r.i < nx) GROUP BY 1, 2),
g AS (SELECT * FROM b WHERE body <> '')
SELECT * FROM g UNION ALL SELECT doc_id, 'Full Document', regexp_replace(text, '^\s+|\s+$', '', 'g') FROM filing_texts WHERE doc_id NOT IN (SELECT doc_id FROM g)"""


@query("d2_detect_sections", "SELECT doc_id, section, length(body) AS chars, md5(body) AS digest FROM doc_sections")
def d2(spark, sf):
    s = tx.detect_sections(bv.filing_texts(spark, sf).select("doc_id", "text"))
    return s.select("doc_id", "section", F.length("section_text").cast("long").alias("chars"), F.md5("section_text").alias("digest"))


VIEWS["item_lines"] = r"""
SELECT doc_id, i, line, CASE WHEN length(line) <= 200 THEN nullif(lower(regexp_extract(line, '(?i)^\s*item\s*(\d{1,2}[a-c]?)\b\s*[\.\:\-–—]?\s*(.*)$', 1)), '') END AS item,
  trim(regexp_extract(line, '(?i)^\s*item\s*(\d{1,2}[a-c]?)\b\s*[\.\:\-–—]?\s*(.*)$', 2)) AS rest FROM doc_lines"""


def _section_sql(name: str) -> str:
    t = {"risk_factors": r"(?i)^risk\s*factors\.?$", "mdna": r"(?i)^management[''’`]?s\s*discussion\s*and\s*analysis"}[name]
    want = {"risk_factors": "'1a'", "mdna": "CASE WHEN d.filing_type = '10-K' THEN '7' ELSE '2' END"}[name]
    return f"""(WITH w AS (SELECT d.doc_id, {want} AS want FROM filing_texts d),
h0 AS (SELECT l.doc_id, l.i, want FROM item_lines l JOIN w USING (doc_id) WHERE (item = want AND rest <> '' AND regexp_matches(rest, '{t}')) OR (item IS NULL AND line <> '' AND length(line) <= 200 AND regexp_matches(line, '{t}'))
  UNION SELECT l.doc_id, z.i, want FROM item_lines l JOIN w USING (doc_id) JOIN LATERAL (SELECT min(q.i) AS i, arg_min(q.line, q.i) AS line FROM doc_lines q WHERE q.doc_id = l.doc_id AND q.i > l.i AND q.i <= l.i + 5 AND q.line <> '') z ON true
    WHERE item = want AND rest = '' AND regexp_matches(z.line, '{t}')),
h AS (SELECT * FROM h0 WHERE NOT coalesce(regexp_full_match((SELECT arg_min(l.line, l.i) FROM doc_lines l WHERE l.doc_id = h0.doc_id AND l.i > h0.i AND l.i <= h0.i + 10 AND l.line <> ''), '[0-9]{{1,4}}'), false)),
e AS (SELECT h.*, (SELECT min(l.i) FROM item_lines l WHERE l.doc_id = h.doc_id AND l.i > h.i AND l.item IS NOT NULL AND l.item <> h.want) AS nx FROM h),
b AS (SELECT e.doc_id, e.i, regexp_replace(string_agg(r.line, chr(10) ORDER BY r.i), '^\\s+|\\s+$', '', 'g') AS body FROM e JOIN doc_lines r ON r.doc_id = e.doc_id AND r.i > e.i AND (nx IS NULL OR r.i < nx) GROUP BY 1, 2),
m AS (SELECT doc_id, arg_max(body, (length(body), -i)) AS body FROM b GROUP BY 1)
SELECT doc_id, body FROM m)"""


@query("d5_extract_sections", f"""
SELECT f.doc_id, length(a.body) AS risk_chars, md5(a.body) AS risk_digest, coalesce(length(a.body) BETWEEN 1500 AND 400000, false) AS risk_usable, length(b.body) AS mdna_chars, md5(b.body) AS mdna_digest,
  coalesce(length(b.body) BETWEEN 1500 AND 400000, false) AS mdna_usable
FROM filing_texts f LEFT JOIN {_section_sql('risk_factors')} a ON a.doc_id = f.doc_id LEFT JOIN {_section_sql('mdna')} b ON b.doc_id = f.doc_id""")
def d5(spark, sf):
    d = bv.filing_texts(spark, sf).select("doc_id", F.col("filing_type").alias("form"), "text")
    x = tx.extract_sections(d)
    return x.select("doc_id", F.length("risk_factors").cast("long").alias("risk_chars"), F.md5("risk_factors").alias("risk_digest"), F.col("risk_factors_usable").alias("risk_usable"),
                    F.length("mdna").cast("long").alias("mdna_chars"), F.md5("mdna").alias("mdna_digest"), "mdna_usable")


def _cut_sql(source: str, keys: str) -> str:
    """Chunks of ``source`` (``keys``, body) as ``keys``, k, start, stop, chunk: the cuts one after the other."""
    part = "length(regexp_extract(substr(body, start + 1, 4500), '(?s)^.*(?:\\n|[.;:] )'))"
    ends = f"CASE WHEN start + 4500 >= length(body) THEN length(body) WHEN {part} > 2250 THEN start + {part} ELSE start + 4500 END"
    return f"""WITH RECURSIVE src AS (SELECT {keys}, 0 AS k, 0 AS start, regexp_replace(regexp_replace(body, '\\r\\n?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM ({source})),
step AS (SELECT {keys}, body, k, start, {ends} AS stop FROM src WHERE length(body) > 0
  UNION ALL SELECT {keys}, body, k, start, {ends} AS stop FROM (SELECT {keys}, body, k + 1 AS k, stop - 200 AS start FROM step WHERE stop < length(body)) n)
SELECT {keys}, k, start, stop, regexp_replace(substr(body, start + 1, stop - start), '^\\s+|\\s+$', '', 'g') AS chunk FROM step"""


@query("d6_split_into_chunks", f"SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS chunk_start, CAST(length(chunk) AS INTEGER) AS chars, md5(chunk) AS digest FROM ({_cut_sql('SELECT doc_id, text AS body FROM documents', 'doc_id')})")
def d6(spark, sf):
    d = tx.split_into_chunks(bv.spread(bv.table(spark, sf, "documents")).select("doc_id", "text"), "text")
    return d.select("doc_id", "chunk_index", "chunk_start", F.length("chunk_text").alias("chars"), F.md5("chunk_text").alias("digest"))


@query("d6_chunks_cover_the_text", r"""
SELECT doc_id, length(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g'))::BIGINT AS chars, 0::BIGINT AS missing, true AS short FROM documents WHERE regexp_matches(text, '\S')""")
def d6_cover(spark, sf):
    """Characters of the trimmed text that no chunk holds, and whether every chunk is at most 4,500 long: 0 and true."""
    c = tx.split_into_chunks(bv.spread(bv.table(spark, sf, "documents")).select("doc_id", "text"), "text")
    cuts = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_start", "chunk_stop"))).alias("s"), F.max(F.col("chunk_stop") - F.col("chunk_start")).alias("longest"))
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("gap"))
    held = F.aggregate("s", zero, lambda s, x: F.struct(F.greatest(s["to"], x["chunk_stop"]).alias("to"), (s["gap"] + F.greatest(x["chunk_start"] - s["to"], F.lit(0))).cast("int").alias("gap")))
    whole = bv.table(spark, sf, "documents").select("doc_id", F.length(tx.strip(F.regexp_replace("text", r"\r\n?", "\n"))).cast("long").alias("chars"))
    return cuts.withColumn("held", held).join(whole, "doc_id").select("doc_id", "chars", (F.col("held.gap") + F.col("chars") - F.col("held.to")).cast("long").alias("missing"), (F.col("longest") <= 4500).alias("short"))


@query("d7_process_documents", f"""
SELECT f.ticker, f.filing_type, '2020-01-31' AS filing_date, c.section, f.ticker || '_' || replace(coalesce(f.filing_type, 'DOC'), '-', '') || '_' || upper(regexp_replace(regexp_replace(c.section, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) || '_' || lpad(CAST(k AS VARCHAR), 3, '0') AS chunk_id,
  CAST(k AS INTEGER) AS chunk_index, sha256(trim(regexp_replace(chunk, '\\s+', ' ', 'g'))) AS content_hash, f.source_file, f.accession_number, CAST(length(f.text) AS INTEGER) AS document_length
FROM ({_cut_sql('SELECT doc_id, section, body FROM doc_sections', 'doc_id, section')}) c JOIN filing_texts f USING (doc_id)""")
def d7(spark, sf):
    return tx.process_documents(bv.filing_texts(spark, sf).drop("doc_id")).drop("text")


@query("d8_chunk_ids", "SELECT chunk_id, upper(ticker) || '_' || replace(filing_type, '-', '') || '_' || upper(regexp_replace(regexp_replace(section, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) || '_' || lpad(CAST(chunk_index AS VARCHAR), 3, '0') AS made FROM chunks")
def d8(spark, sf):
    c = bv.chunks(spark, sf)
    return c.select("chunk_id", tx.chunk_id(F.upper("ticker"), F.col("filing_type"), F.col("section"), F.col("chunk_index")).alias("made"))


_NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("d9_content_hashes", f"SELECT chunk_id, sha256({_NORM}) AS content_hash, sha256('extract|' || sha256({_NORM}) || '|m|p1|s1') AS cache_key FROM chunks")
def d9(spark, sf):
    lit = F.lit
    return bv.chunks(spark, sf).select("chunk_id", tx.content_hash(F.col("text")).alias("content_hash"),
                                       tx.cache_key(lit("extract"), F.col("text"), lit("m"), lit("p1"), lit("s1")).alias("cache_key"))


@query("d10_chunk_reports", f"""
SELECT 'House ' || d.source AS institution, 'Outlook' AS report_title, '2020-01-01' AS publication_date, 'reports/' || doc_id || '.txt' AS source_path,
  substr(replace('House ' || d.source, ' ', '_'), 1, 40) || '_' || substr(sha256('reports/' || doc_id || '.txt'), 1, 10) || '_' || lpad(CAST(k AS VARCHAR), 3, '0') AS chunk_id, CAST(k AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS chunk_start
FROM ({_cut_sql('SELECT doc_id, text AS body FROM documents', 'doc_id')}) JOIN documents d USING (doc_id)""")
def d10(spark, sf):
    r = bv.table(spark, sf, "documents").select(F.concat(F.lit("House "), "source").alias("institution"), F.lit("Outlook").alias("report_title"), F.lit("2020-01-01").alias("publication_date"),
                                                F.format_string("reports/%d.txt", "doc_id").alias("source_path"), "text")
    return tx.chunk_reports(r).drop("text")


# --- D11-D15: similarity ---------------------------------------------------------------------------------------------

# The stop list is Spark's own; the SQL side receives the same list.
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "which", "les", "des", "der", "die", "und", "que", "los", "las")
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: Suffix of the views of a section, and its column.
_SECTIONS = {"": "risk_factors", "_md": "mdna"}
for _x, _column in _SECTIONS.items():
    VIEWS[f"tok{_x}"] = rf"""
SELECT accession, term, count(*) AS tf FROM (SELECT accession, unnest(regexp_extract_all(lower({_column}), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM sections) WHERE term NOT IN ({_STOP}) GROUP BY 1, 2"""
    VIEWS[f"idf{_x}"] = f"""
WITH r AS (SELECT accession FROM sections WHERE filing_date < DATE '2014-01-01' AND coalesce({_column}, '') <> ''), n AS (SELECT count(*) AS n FROM r)
SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf, count(*) AS df FROM tok{_x} JOIN r USING (accession), n GROUP BY term, n HAVING count(*) >= 5 AND count(*) <= 0.9 * n"""
    VIEWS[f"tfidf{_x}"] = f"""
SELECT accession, term, w / sqrt(sum(w * w) OVER (PARTITION BY accession)) AS weight FROM (SELECT accession, term, (1 + ln(tf)) * idf AS w FROM tok{_x} JOIN idf{_x} USING (term))"""


@bv.staged
def token_counts(spark, sf):
    """Word counts per filing, tokenised once for every query that reads them."""
    return tx.term_counts(bv.sections(spark, sf), "accession", "risk_factors", STOP_WORDS)


def _counts(spark, sf):
    return bv.sections(spark, sf).drop("risk_factors", "mdna"), token_counts(spark, sf)


@query("d11_tfidf_fit", "SELECT term, round(idf, 6) + 0.0 AS idf FROM idf")
def d11(spark, sf):
    s, counts = _counts(spark, sf)
    ref = s.filter(F.col("filing_date") < "2014-01-01").select("accession")
    return tidy(tx.fit_idf(counts.join(ref, "accession", "left_semi"), ref, "accession"))


VIEWS["paired"] = """
WITH c AS (SELECT a.accession, b.accession AS p, b.filing_date AS pf, CASE WHEN a.form = '10-K' THEN a.filing_date - b.filing_date BETWEEN 300 AND 430 END AS ann,
  CASE WHEN a.form <> '10-K' THEN a.report_date - b.report_date BETWEEN 350 AND 380 END AS per, CASE WHEN a.form <> '10-K' THEN a.filing_date - b.filing_date BETWEEN 330 AND 400 END AS fil
  FROM sections a JOIN sections b ON a.cik = b.cik AND a.form = b.form AND b.filing_date < a.filing_date),
x AS (SELECT accession, arg_max(p, (pf, p)) FILTER (ann) AS a, arg_max(p, (pf, p)) FILTER (per) AS q, arg_max(p, (pf, p)) FILTER (fil) AS f FROM c GROUP BY 1)
SELECT s.cik, s.accession, s.form, s.filing_date, CASE WHEN s.form = '10-K' THEN a ELSE coalesce(q, f) END AS prior_accession FROM sections s JOIN x USING (accession) WHERE CASE WHEN s.form = '10-K' THEN a ELSE coalesce(q, f) END IS NOT NULL"""
for _x, _column in _SECTIONS.items():
    VIEWS[f"sims{_x}"] = f"""
SELECT p.cik, p.accession, p.form, p.filing_date, p.prior_accession, CASE WHEN p.accession IN (SELECT accession FROM tfidf{_x}) AND p.prior_accession IN (SELECT accession FROM tfidf{_x}) THEN coalesce(d.s, 0) END AS sim,
  CASE WHEN length(a.{_column}) > 0 AND length(b.{_column}) > 0 THEN ln(length(a.{_column}) / length(b.{_column})) END AS len_chg FROM paired p JOIN sections a ON a.accession = p.accession JOIN sections b ON b.accession = p.prior_accession
LEFT JOIN (SELECT p.accession, sum(x.weight * y.weight) AS s FROM paired p JOIN tfidf{_x} x ON x.accession = p.accession JOIN tfidf{_x} y ON y.accession = p.prior_accession AND y.term = x.term GROUP BY 1) d ON d.accession = p.accession"""
VIEWS["pooled"] = """
WITH e AS (SELECT vec_id % 50 AS key, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT key, i, avg(v::DOUBLE) AS m FROM e GROUP BY 1, 2)
SELECT key, list(m ORDER BY i) AS v FROM m GROUP BY 1"""
VIEWS["filing_feat"] = """
WITH s AS (SELECT p.*, CASE WHEN p.form = '10-K' AND coalesce(x.risk_factors, '') <> '' AND coalesce(y.risk_factors, '') <> '' THEN list_cosine_similarity(a.v, b.v) END AS emb_rf, CASE WHEN p.form = '10-K' AND coalesce(x.mdna, '') <> '' AND coalesce(y.mdna, '') <> '' THEN list_cosine_similarity(a.v, b.v) END AS emb_md
  FROM paired p JOIN sections x ON x.accession = p.accession JOIN sections y ON y.accession = p.prior_accession
  LEFT JOIN pooled a ON a.key = CAST(substr(p.accession, 2) AS BIGINT) % 50 LEFT JOIN pooled b ON b.key = CAST(substr(p.prior_accession, 2) AS BIGINT) % 50)
SELECT s.cik, s.accession, s.form, s.filing_date, s.prior_accession, r.sim AS sim_tfidf_rf, emb_rf AS sim_emb_rf, r.sim - lag(r.sim) OVER w AS dsim_tfidf_rf, r.len_chg AS len_chg_rf,
  m.sim AS sim_tfidf_mdna, emb_md AS sim_emb_mdna, m.sim - lag(m.sim) OVER w AS dsim_tfidf_mdna, m.len_chg AS len_chg_mdna
FROM s JOIN sims r USING (accession) JOIN sims_md m USING (accession) WINDOW w AS (PARTITION BY s.cik, s.form ORDER BY s.filing_date, s.accession)"""


@query("d12_cosine_pairs", "SELECT accession, prior_accession, round(sim, 6) + 0.0 AS sim FROM sims")
def d12(spark, sf):
    s, counts = _counts(spark, sf)
    ref = s.filter(F.col("filing_date") < "2014-01-01").select("accession")
    idf = tx.fit_idf(counts.join(ref, "accession", "left_semi"), ref, "accession")
    pairs = tx.year_ago_filing(s.select("cik", "accession", "form", "filing_date", "report_date")).filter(F.col("prior_accession").isNotNull()).select("accession", "prior_accession")
    return tidy(tx.cosine_pairs(pairs, cut_lineage(tx.packed_vectors(counts, idf, "accession")), "accession", "prior_accession", "accession", "sim"))


def _filing_features(spark, sf):
    """Similarity features; the pooled vectors stand in for both sections."""
    s = bv.sections(spark, sf)
    ids = s.select("accession", (F.expr("cast(substring(accession, 2) as bigint)") % 50).alias("key")).join(_pooled(spark, sf), "key")
    vec = ids.select("accession", F.explode(F.array(F.lit("risk_factors"), F.lit("mdna"))).alias("section"), "vec")
    return tx.filing_features(s, "2014-01-01", STOP_WORDS, vec)


@bv.staged
def filing_feature_table(spark, sf):
    return _filing_features(spark, sf)


@query("d13_filing_features", f"SELECT cik, accession, form, filing_date, prior_accession, {rounded(tx.SIMILARITY_FEATURES)} FROM filing_feat")
def d13(spark, sf):
    return tidy(_filing_features(spark, sf), "cik", "accession", "form", "filing_date", "prior_accession", *tx.SIMILARITY_FEATURES)


_SPACED = """
WITH n AS (SELECT doc_id, text, CAST(ceil(length(text) / 1000) AS INTEGER) AS n FROM documents),
i AS (SELECT doc_id, text, unnest(range(0, {parts})) AS k, n FROM n WHERE n > 0),
p AS (SELECT doc_id, k, {spot} AS spot, text FROM i)
SELECT doc_id, CAST(k AS INTEGER) AS k, md5(substr(text, spot * 1000 + 1, 1000)) AS digest FROM p"""


@query("d14_spaced_chunks", _SPACED.format(parts="n", spot="k"))
def d14(spark, sf):
    """All parts of every text."""
    d = bv.table(spark, sf, "documents").select("doc_id", F.posexplode(tx.spaced_chunks(F.col("text"))).alias("k", "chunk"))
    return d.select("doc_id", "k", F.md5("chunk").alias("digest"))


@query("d14_eight_spaced_chunks", _SPACED.format(parts="least(n, 8)", spot="CASE WHEN n <= 8 THEN k ELSE CAST(round_even(k * (n - 1) / 7, 0) AS INTEGER) END"))
def d14_eight(spark, sf):
    """Eight parts spread over every text: the number is the feature asked for."""
    d = bv.table(spark, sf, "documents").select("doc_id", F.posexplode(tx.spaced_chunks(F.col("text"), limit=8)).alias("k", "chunk"))
    return d.select("doc_id", "k", F.md5("chunk").alias("digest"))


def _pooled(spark, sf):
    return tx.pool_vectors(bv.table(spark, sf, "embeddings").select((F.col("vec_id") % 50).alias("key"), "embedding"), "key", "embedding")


@query("d15_pooled_vectors", """
WITH e AS (SELECT vec_id % 50 AS key, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT key, i, avg(v::DOUBLE) AS m FROM e GROUP BY 1, 2),
n AS (SELECT key, sqrt(sum(m * m)) AS nn FROM m GROUP BY 1) SELECT key, CAST(i - 1 AS INTEGER) AS dim, round(m / nn, 6) + 0.0 AS value FROM m JOIN n USING (key)""")
def d15(spark, sf):
    return tidy(_pooled(spark, sf).select("key", F.posexplode("vec").alias("dim", "value")))


@query("t2_monthly_text_features", f"""
WITH k AS (SELECT DISTINCT date, CAST(substr(ticker, 2) AS BIGINT) % 20 AS cik, ticker FROM panel),
f AS (SELECT *, filing_date - 4500 AS fd FROM filing_feat QUALIFY row_number() OVER (PARTITION BY cik, filing_date ORDER BY accession DESC) = 1)
SELECT k.date, k.ticker, CASE WHEN k.date - f.fd <= 200 THEN f.fd END AS filing_date, {', '.join(f'round(CASE WHEN k.date - f.fd <= 200 THEN {c} END, 6) + 0.0 AS {c}' for c in tx.SIMILARITY_FEATURES)}
FROM k ASOF LEFT JOIN f ON k.cik = f.cik AND k.date >= f.fd""")
def t2m(spark, sf):
    """Text features shifted onto the price history and aligned to it, null when stale."""
    ff = filing_feature_table(spark, sf).withColumn("filing_date", F.date_sub("filing_date", 4500))
    keys = bv.panel(spark, sf).select("date", "ticker")
    who = keys.select("ticker").distinct().withColumn("cik", F.expr("cast(substring(ticker, 2) as bigint)") % 20)
    return tidy(tx.monthly_text_features(ff, keys, who), "date", "ticker", "filing_date", *tx.SIMILARITY_FEATURES)


# --- D16-D18: extraction inputs -------------------------------------------------------------------------------------

@query("d16_prioritised_chunks", """
SELECT ticker, section, filing_date, chunk_id, CAST(coalesce(list_position(['MD&A', 'Management''s Discussion and Analysis', 'Risk Factors', 'Business', 'Financial Statements', 'Notes to Financial Statements',
  'Market Risk', 'Quantitative and Qualitative Disclosures About Market Risk', 'Legal Proceedings', 'News'], trim(section)) - 1, 10) AS INTEGER) AS priority FROM chunks ORDER BY ticker, priority, filing_date, chunk_id""")
def d16(spark, sf):
    return tx.prioritised(bv.chunks(spark, sf)).select("ticker", "section", "filing_date", "chunk_id", "priority")


_KEY = f"sha256('x|' || sha256({_NORM}) || '|m|v1|v1')"


@query("d17_estimate_run", f"""
WITH k AS (SELECT {_KEY} AS key, length(text) AS chars, chunk_id, ticker FROM chunks), one AS (SELECT key, arg_min(chars, chunk_id) AS chars FROM k GROUP BY 1), hit AS (SELECT DISTINCT key FROM k WHERE ticker IN ('src1', 'src2', 'src3'))
SELECT (SELECT count(*) FROM k) AS documents, count(*) AS unique_chunks, count(h.key) AS cache_hits, count(*) - count(h.key) AS llm_calls_required,
  CAST(coalesce(sum(chars) FILTER (h.key IS NULL), 0) // 4 AS BIGINT) AS estimated_input_tokens FROM one LEFT JOIN hit h USING (key)""")
def d17(spark, sf):
    c = bv.chunks(spark, sf)
    lit = F.lit
    cached = c.filter(F.col("ticker").isin("src1", "src2", "src3")).select(tx.cache_key(lit("x"), F.col("text"), lit("m"), lit("v1"), lit("v1")).alias("key"))
    return tx.estimate_run(c, cached, "x", "m").select("documents", "unique_chunks", "cache_hits", "llm_calls_required", "estimated_input_tokens")


@query("d18_clean_signals", """
WITH r AS (SELECT event_id AS seq, 'c' || (event_id // 40) AS chunk_id, CASE WHEN event_type = 'error' THEN 'risk' WHEN event_type = 'view' THEN 'nonsense' ELSE 'earnings' END AS signal_type,
  CASE WHEN value > 50 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN event_id % 11 = 0 THEN '1.5' WHEN event_id % 13 = 0 THEN 'high' ELSE CAST(event_id % 100 / 100 AS VARCHAR) END AS strength,
  CASE WHEN event_id % 3 = 0 THEN ' 12.5 ' WHEN event_id % 3 = 1 THEN '' ELSE 'n/a' END AS metric_value FROM events),
c AS (SELECT *, try_cast(strength AS DOUBLE) AS s, try_cast(trim(metric_value) AS DOUBLE) AS m FROM r WHERE signal_type <> 'nonsense' AND try_cast(strength AS DOUBLE) BETWEEN 0 AND 1)
SELECT seq, chunk_id, signal_type, direction, s AS strength, m AS metric_value FROM c""")
def d18(spark, sf):
    i, e = F.col("event_id"), F.col("event_type")
    r = bv.table(spark, sf, "events").select(
        i.alias("seq"), F.concat(F.lit("c"), F.floor(i / 40).cast("string")).alias("chunk_id"), F.when(e == "error", "risk").when(e == "view", "nonsense").otherwise("earnings").alias("signal_type"),
        F.when(F.col("value") > 50, "positive").otherwise("negative").alias("direction"),
        F.when(i % 11 == 0, "1.5").when(i % 13 == 0, "high").otherwise((i % 100 / 100).cast("string")).alias("strength"),
        F.when(i % 3 == 0, " 12.5 ").when(i % 3 == 1, "").otherwise("n/a").alias("metric_value"), F.lit(None).cast("string").alias("growth_rate"))
    return tx.clean_signals(r).select("seq", "chunk_id", "signal_type", "direction", "strength", "metric_value")
