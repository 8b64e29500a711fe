"""Queries over pages, documents and vectors: cleaning, filters, tag statistics, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import html as H
from quoin.operators import dom
from quoin.operators import similarity as M
from quoin.sources import relations as S

from .catalogue import query


def pages(spark, d):
    return S.read(spark, d, "pages")


def digested(rows):
    """page_id, digest and length of html."""
    return rows.select("page_id", F.md5(F.col("html").cast("binary")).alias("digest"), F.length("html").cast("long").alias("n"))


def cleaned(name: str, column, sql: str):
    """Register a query that digests one cleaning step's result for each page."""

    @query(name, f"select page_id, md5(h) as digest, length(h) as n from (select page_id, {sql} as h from pages)")
    def run(spark, d):
        rows = pages(spark, d).select("page_id", column(F.col("html")).alias("h"))
        return rows.select("page_id", F.md5(F.col("h").cast("binary")).alias("digest"), F.length("h").cast("long").alias("n"))

    return run


def element(tag: str, inner: str) -> str:
    return f"regexp_replace({inner}, '(?s)<{tag}.*?</{tag}>', '', 'g')"


ELEMENTS_SQL = "html"
for _tag in ("script", "audio", "video", "iframe", "map", "svg"):
    ELEMENTS_SQL = element(_tag, ELEMENTS_SQL)
META_SQL = "list_reduce(list_prepend({0}, list_filter(regexp_extract_all({0}, '(?i)<meta[^>]+>'), lambda t: not (contains(lower(t), 'charset=') or contains(lower(t), 'http-equiv=') or contains(lower(t), 'name=\"viewport\"')))), lambda s, t: replace(s, t, ''))"
LINES_SQL = "array_to_string(list_filter(string_split({0}, chr(10)), lambda x: replace(x, ' ', '') <> ''), chr(10))"
cleaned("str01_remove_elements", H.remove_elements, ELEMENTS_SQL)
cleaned("str02_remove_meta", H.remove_meta, META_SQL.format("html"))
cleaned("str03_remove_comments", H.remove_comments, "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')")
cleaned("str04_remove_css_comments", H.remove_css_comments, r"regexp_replace(html, '(?s)/\*.*?\*/', '', 'g')")
cleaned("str05_remove_blank_lines", H.remove_blank_lines, LINES_SQL.format("html"))
cleaned("str06_blank_links", H.blank_links, r"""regexp_replace(html, '"(?:https?://|www\.)[^"\s]+"', '""', 'g')""")
cleaned("str07_remove_attributes", lambda h: H.remove_attribute(H.remove_attribute(h, "href"), "srcset"), """regexp_replace(regexp_replace(html, 'href="[^"]*"', '', 'g'), 'srcset="[^"]*"', '', 'g')""")
cleaned("str08_remove_links", H.remove_link_elements, "regexp_replace(html, '<link[^>]*href[^>]*>', '', 'g')")
cleaned("str10_remove_imports", H.remove_imports, "array_to_string(list_filter(string_split(html, chr(10)), lambda x: not contains(x, '@import')), chr(10))")
cleaned("str16_placeholder_images", H.placeholder_images, r"""regexp_replace(regexp_replace(html, '(<img[^>]*src=")[^"]*("[^>]*>)', '\1rick.jpg\2', 'g'), '"[^"]*\.jpg"', '"rick.jpg"', 'g')""")
cleaned("str17_inline_placeholder", lambda h: H.inline_placeholder(F.replace(h, F.lit("</p>"), F.lit("rick.jpg</p>")), "data:,x"), "replace(replace(html, '</p>', 'rick.jpg</p>'), 'rick.jpg', 'data:,x')")
cleaned("str18_strip_fences", lambda h: H.strip_fences(F.concat(F.lit("```html\n"), h, F.lit("\n```"))), r"trim(regexp_replace(regexp_replace('```html' || chr(10) || html || chr(10) || '```', '^```(?:html)?[ \t]*\n\s*', ''), '\s*```$', ''))")
cleaned("str19_remove_overflow", lambda h: H.remove_overflow(F.concat(h, F.lit("<p style='overflow: auto;'>"))), "replace(html || '<p style=''overflow: auto;''>', 'overflow: auto;', '')")
cleaned("str21_wrap_document", lambda h: H.wrap_document(F.replace(h, F.lit("<html lang=\"en\">"), F.lit(""))), """case when regexp_matches(replace(html, '<html lang="en">', ''), '(?i)<html[^>]*>') then replace(html, '<html lang="en">', '') else '<html><body><p>' || replace(html, '<html lang="en">', '') || '</p></body></html>' end""")
cleaned("hlp23_document_wrapper", H.escape, "replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')")
CSS_PAGE = "html || '<style>a{b:url( \"x/y.PNG?v=1\" )} c{d:url(font.woff)} e{f:url(data:image/png;base64,AA)}</style><a class=\"k\" href=\"https://o.example/z\">z</a><a href=\"/in\">i</a>'"
NEUTRAL_SQL = rf"""regexp_replace({{0}}, '(?i)(<a\s[^>]*href=)"http[^"]*"', '\1"#"', 'g')"""
NEUTRAL_SQL = rf"""regexp_replace({NEUTRAL_SQL}, 'url\s*\(\s*[''"]?(data:[^)''"]*)[''"]?\s*\)', chr(57344) || '(\1)', 'g')"""
NEUTRAL_SQL = rf"""regexp_replace(regexp_replace({NEUTRAL_SQL}, '(?i)url\s*\([^)?#]*\.(?:png|gif|ico|jpg|jpeg|webp|svg)[''"]?\s*(?:[?#][^)]*)?\)', chr(57345), 'g'), 'url\s*\([^)]+\)', 'url()', 'g')"""
NEUTRAL_SQL = f"replace(replace({NEUTRAL_SQL}, chr(57344) || '(', 'url('), chr(57345), 'url(placeholder.png)')"
cleaned("str26_neutral_links", lambda h: H.neutral_links(F.expr(CSS_PAGE)), NEUTRAL_SQL.format(f"({CSS_PAGE})"))


def chain_sql() -> str:
    h = f"regexp_replace({META_SQL.format('q')}, '(?s)<!--.*?-->', '', 'g')"
    h = rf"regexp_replace({h}, '(?s)/\*.*?\*/', '', 'g')"
    h = f"""regexp_replace(regexp_replace({h}, 'href="[^"]*"', '', 'g'), 'srcset="[^"]*"', '', 'g')"""
    h = f"regexp_replace({h}, '<link[^>]*href[^>]*>', '', 'g')"
    h = rf"""regexp_replace({h}, '"(?:https?://|www\.)[^"\s]+"', '""', 'g')"""
    h = f"array_to_string(list_filter(string_split({h}, chr(10)), lambda x: not contains(x, '@import')), chr(10))"
    return LINES_SQL.format(h)


@query("gen13_clean_chain", f"with p as (select page_id, {ELEMENTS_SQL} as q from pages) select page_id, md5(h) as digest, length(h) as n from (select page_id, {chain_sql()} as h from p)")
def gen13(spark, d):
    rows = pages(spark, d).select("page_id", H.clean_page(F.col("html")).alias("h"))
    return rows.select("page_id", F.md5(F.col("h").cast("binary")).alias("digest"), F.length("h").cast("long").alias("n"))


@query("str15_redact", r"select doc_id, md5(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL REDACTED]', 'g'), '\(?\b\d{3}\)?[-.]?\s?\d{3}[-.]?\d{4}\b', '[PHONE REDACTED]', 'g')) as digest from documents")
def str15(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.md5(H.redact(F.col("text")).cast("binary")).alias("digest"))


@query("str25_absolute_url", r"""with p as (select page_id, url, regexp_extract(html, 'href="([^"]*)"', 1) as link from pages)
    select page_id, case when link = '' then regexp_replace(url, '#.*$', '') when starts_with(link, '/') then regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || link else link end as url from p""")
def str25(spark, d):
    link = F.regexp_extract("html", 'href="([^"]*)"', 1)
    return pages(spark, d).select("page_id", H.absolute_url(F.col("url"), link).alias("url"))


@query("flt10_validator", f"select page_id, not ({' or '.join(f"contains(lower(html), '{p}')" for p in H.STOP_PHRASES)}) as valid from pages")
def flt10(spark, d):
    return pages(spark, d).select("page_id", H.valid(F.col("html")).alias("valid"))


@query("flt11_word_band", r"select page_id from pages where len(string_split(html, ' ')) > 100 and len(string_split(html, ' ')) < 32000")
def flt11(spark, d):
    """Length band over words split at spaces, standing in for an external tokenizer."""
    n = F.size(F.split("html", " "))
    return pages(spark, d).where((n > 100) & (n < 32000)).select("page_id")


@query("flt12_line_band", "select page_id, len(string_split(html, '</p>')) as n from pages where len(string_split(html, '</p>')) > 4 and len(string_split(html, '</p>')) < 10000")
def flt12(spark, d):
    n = F.size(F.split("html", "</p>"))
    return pages(spark, d).where((n > 4) & (n < 10000)).select("page_id", n.cast("long").alias("n"))


@query("flt16_snippet_reasons", r"select page_id, regexp_matches(html, '(?i)position\s*:\s*(?:fixed|absolute)') as positioned from pages")
def flt16(spark, d):
    return pages(spark, d).select("page_id", F.array_contains(H.snippet_reasons(F.col("html")), "positioned").alias("positioned"))


TAGS_SQL = "tags as (select page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) as tag from pages)"


@query("agg26_tag_frequency", f"with {TAGS_SQL} select tag, count(*) as n, count(distinct page_id) as pages from tags group by tag")
def agg26(spark, d):
    tags = pages(spark, d).select("page_id", F.explode(H.opening_tags(F.col("html"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query("srt11_top_tags", f"with {TAGS_SQL} select tag, count(*) as n from tags group by tag order by n desc, tag limit 12")
def srt11(spark, d):
    return agg26(spark, d).select("tag", "n").orderBy(F.desc("n"), "tag").limit(12)


@query("flt19_known_tags", f"with {TAGS_SQL} select page_id, count(*) as n, count(distinct tag) as distinct_tags from tags where tag in ({', '.join(repr(t) for t in H.TAGS)}) group by page_id")
def flt19(spark, d):
    tags = pages(spark, d).select("page_id", F.explode(H.opening_tags(F.col("html"))).alias("tag")).where(F.col("tag").isin(H.TAGS))
    return tags.groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("tag").alias("distinct_tags"))


@query("agg27_corpus_moments", f"with {TAGS_SQL}, p as (select page_id, count(*) as n, count(distinct tag) as u from tags group by page_id) select round(avg(n), 6) as mean_tags, round(stddev_pop(n), 6) as sd_tags, round(avg(u), 6) as mean_unique, round(stddev_pop(u), 6) as sd_unique from p")
def agg27(spark, d):
    tags = H.opening_tags(F.col("html"))
    p = pages(spark, d).select(F.size(tags).alias("n"), F.size(F.array_distinct(tags)).alias("u"))
    r = lambda x: F.round(x, 6)
    return p.agg(r(F.avg("n")).alias("mean_tags"), r(F.stddev_pop("n")).alias("sd_tags"), r(F.avg("u")).alias("mean_unique"), r(F.stddev_pop("u")).alias("sd_unique"))


@query("src15_page_lengths", "select page_id, length(html) as n, md5(url) as u from pages")
def src15(spark, d):
    return pages(spark, d).select("page_id", F.length("html").cast("long").alias("n"), F.md5("url").alias("u"))


@query("src06_selected_pages", "select page_id from pages where contains(url, '.html') and not contains(url, 'spam')")
def src06(spark, d):
    return pages(spark, d).where(F.col("url").contains(".html") & ~F.col("url").contains("spam")).select("page_id")


@query("src07_first_urls", "select page_id, url from pages order by page_id limit 100")
def src07(spark, d):
    """The first 100 URLs: the limit is the feature."""
    return pages(spark, d).orderBy("page_id").limit(100).select("page_id", "url")


@query("src08_url_shard", "select distinct regexp_extract(url, '^[a-z]+://([^/]*)', 1) as host from pages")
def src08(spark, d):
    return pages(spark, d).select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host")).distinct()


@query("src09_text_column", "select lang, count(*) as n, cast(sum(length(text)) as bigint) as chars from documents group by lang")
def src09(spark, d):
    return S.read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("win14_repeated_chunks", "with c as (select doc_id, unnest(string_split(text, '. ')) as chunk from documents), n as (select doc_id, chunk, count(*) as n from c where length(chunk) > 0 group by all) select doc_id, count(*) as repeated from n where n >= 2 group by doc_id")
def win14(spark, d):
    """Chunks that a document repeats, exact form."""
    chunks = S.read(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"\. ")).alias("chunk")).where("chunk != ''")
    counts = chunks.groupBy("doc_id", "chunk").agg(F.count("*").alias("n")).where("n >= 2")
    return counts.groupBy("doc_id").agg(F.count("*").alias("repeated"))


@query("hsh01_identity", "select page_id, sha256(url || chr(10) || html) as sha, md5(html) as md5, length(base64(encode(url))) as b64 from pages")
def hsh01(spark, d):
    return pages(spark, d).select("page_id", F.sha2(F.concat("url", F.lit("\n"), "html"), 256).alias("sha"), F.md5("html").alias("md5"), F.length(H.base64_line(F.col("url"))).cast("long").alias("b64"))


@query(
    "sim01_cosine",
    """with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0) select q.vec_id as query_id, e.label, round(max(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[]))), 4) as best
    from q join embeddings e on e.vec_id <> q.vec_id group by 1, 2""",
)
def sim01(spark, d):
    """Best cosine of a stated query set with every label's vectors. The queries (one vector in twenty) are held
    against all rows in blocks of a fixed number of queries, so a task's block never grows."""
    e = S.read(spark, d, "embeddings")
    return M.best_by_label(e.where("vec_id % 20 = 0"), e)


@query("agg26_dom_nodes")
def dom_nodes(spark, d):
    """Nodes, depth and distinct tags of every page's DOM."""
    return dom.statistics(pages(spark, d))


@query("srt10_truncated_lists")
def srt10(spark, d):
    """Pages whose lists and tables keep four children each."""
    return digested(dom.transformed(pages(spark, d), "truncate"))


@query("str11_short_sentences")
def str11(spark, d):
    return digested(dom.transformed(pages(spark, d), "sentences"))


@query("str09_replace_objects")
def str09(spark, d):
    return digested(dom.transformed(pages(spark, d), "objects"))


@query("str12_used_css")
def str12(spark, d):
    return digested(dom.transformed(pages(spark, d), "css"))


@query("str20_truncate_repeats")
def str20(spark, d):
    return digested(dom.transformed(pages(spark, d), "repeats"))


@query("str13_packed_variants")
def str13(spark, d):
    """Several pages out of one: its used CSS rules in seeded order, packed by a budget of words."""
    return dom.variants(pages(spark, d)).groupBy("page_id").agg(F.count("*").alias("variants"))


@query("str14_reduced_bodies")
def str14(spark, d):
    return digested(dom.transformed(pages(spark, d), "reduce"))


@query("str27_flattened_pages")
def str27(spark, d):
    return digested(dom.transformed(pages(spark, d), "flatten"))


@query(
    "str28_sanitised",
    r"""select page_id, md5(h) as digest, length(h) as n from (select page_id, trim(case when regexp_matches(html, '(?i)<body') then regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1)
    else regexp_replace(regexp_replace(html, '(?is)<head.*?</head>', '', 'g'), '(?i)<!doctype[^>]*>|</?html[^>]*>|</?body[^>]*>', '', 'g') end) as h from pages)""",
)
def str28(spark, d):
    return digested(pages(spark, d).select("page_id", H.unwrap_document(F.col("html")).alias("html")))


@query("prj29_text_colours")
def prj29(spark, d):
    """Text pieces with the colour they inherit."""
    return dom.texts(pages(spark, d)).groupBy("page_id", "colour").agg(F.count("*").alias("n"))


@query("jon18_used_selectors")
def jon18(spark, d):
    """Simple CSS selectors that match an element of their page."""
    return dom.used_selectors(pages(spark, d))


@query("str22_repetition_cut")
def str22(spark, d):
    """Pages cut where chunks of their text start to repeat; their own text follows them six times."""
    text = F.regexp_replace("html", "<[^>]*>", "")
    rows = pages(spark, d).select("page_id", F.concat("html", F.when(F.col("page_id") % 2 == 0, F.repeat(F.substring(text, 1, 300), 6)).otherwise("")).alias("html"))
    return digested(M.cut_repetition(rows, "page_id", "html"))


@query("hlp14_metric_preparation")
def hlp14(spark, d):
    """What pages go through before they are measured: repetition cut, document wrapper, repeated elements."""
    cut = M.cut_repetition(pages(spark, d), "page_id", "html")
    return digested(dom.transformed(cut.select("page_id", H.wrap_document(F.col("html")).alias("html")), "repeats"))


@query("str23_code_similarity")
def str23(spark, d):
    """Indel similarity of the turns that follow each other in a conversation."""
    return M.turn_similarity(S.read(spark, d, "conversations"), "indel")


@query("str24_text_similarity")
def str24(spark, d):
    return M.turn_similarity(S.read(spark, d, "conversations"), "ratcliff")
