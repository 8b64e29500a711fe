"""HTML and text cleaning as column expressions: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The placeholder image and the phrases that mark a page as no real page.
PLACEHOLDER = "rick.jpg"
CSS_PLACEHOLDER = "placeholder.png"
STOP_PHRASES = ("404", "wordpress", "you have been blocked", "buy this domain", "403 ", "page not found", "squarespace ")


def sub(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def base64_line(text: Column) -> Column:
    """Base64 of the text's UTF-8 bytes in one line; Spark breaks it every 76 characters."""
    return sub(F.base64(F.encode(text, "utf-8")), "\r\n")


def remove_element(html: Column, tag: str) -> Column:
    """Every <tag ...>...</tag>; an element that is never closed stays."""
    return sub(html, rf"(?s)<{tag}.*?</{tag}>")


def remove_elements(html: Column, tags: tuple[str, ...] = ("script", "audio", "video", "iframe", "map", "svg")) -> Column:
    for tag in tags:
        html = remove_element(html, tag)
    return html


def remove_meta(html: Column) -> Column:
    """meta elements but those for charset, http-equiv or viewport."""
    return sub(html, r"(?i)<meta(?![^>]*(?:charset=|http-equiv=|name=\"viewport\"))[^>]+>")


def remove_comments(html: Column) -> Column:
    return sub(html, r"(?s)<!--.*?-->")


def remove_css_comments(html: Column) -> Column:
    return sub(html, r"(?s)/\*.*?\*/")


def remove_blank_lines(text: Column) -> Column:
    """Lines that hold spaces only."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.replace(x, F.lit(" "), F.lit("")) != ""), "\n")


def blank_links(html: Column) -> Column:
    """Quoted web addresses become empty quotes."""
    return sub(html, r"\"(?:https?://|www\.)[^\"\s]+\"", '""')


def remove_attribute(html: Column, name: str) -> Column:
    return sub(html, rf'{name}="[^"]*"')


def remove_link_elements(html: Column) -> Column:
    return sub(html, r"<link[^>]*href[^>]*>")


def remove_imports(text: Column) -> Column:
    """Lines with an @import."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.contains("@import")), "\n")


def redact(text: Column) -> Column:
    """E-mail addresses and phone numbers become fixed marks."""
    text = sub(text, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL REDACTED]")
    return sub(text, r"\(?\b\d{3}\)?[-.]?\s?\d{3}[-.]?\d{4}\b", "[PHONE REDACTED]")


def placeholder_images(html: Column) -> Column:
    """img sources, and quoted names ending in .jpg, become the placeholder."""
    html = sub(html, r"(<img[^>]*src=\")[^\"]*(\"[^>]*>)", f"$1{PLACEHOLDER}$2")
    return sub(html, r"\"[^\"]*\.jpg\"", f'"{PLACEHOLDER}"')


def inline_placeholder(html: Column, data_url: str) -> Column:
    return F.replace(html, F.lit(PLACEHOLDER), F.lit(data_url))


def strip_fences(text: Column) -> Column:
    """Without a leading ```html or bare ``` line and a closing ```; other languages' fences stay."""
    return F.trim(sub(sub(F.trim(text), r"^```(?:html)?[ \t]*\n\s*"), r"\s*```$"))


def fenced_html(text: Column) -> Column:
    """The inside of the first ```html fence; empty without one."""
    return F.regexp_extract(text, r"(?s)```html\s*(.*?)```", 1)


def remove_overflow(html: Column) -> Column:
    return F.replace(html, F.lit("overflow: auto;"), F.lit(""))


def wrap_document(html: Column) -> Column:
    """A fragment without an html element gets one."""
    return F.when(html.rlike(r"(?i)<html[^>]*>"), html).otherwise(F.concat(F.lit("<html><body><p>"), html, F.lit("</p></body></html>")))


def absolute_url(base: Column, link: Column) -> Column:
    """A link resolved against its page's address, without its fragment."""
    link = sub(link, r"#.*$")
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    clean = sub(base, r"[?#].*$")
    folder = F.when(clean.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*$"), F.concat(clean, F.lit("/"))).otherwise(sub(clean, r"[^/]*$"))
    return (
        F.when(link == "", sub(base, r"#.*$"))
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(clean, link))
        .otherwise(F.concat(folder, link))
    )


def neutral_links(html: Column) -> Column:
    """Anchors to other sites point at #; CSS urls become the placeholder if they name an image, else nothing; data urls stay."""
    html = sub(html, r"(?i)(<a\s[^>]*href=)\"http[^\"]*\"", '$1"#"')
    html = sub(html, r"url\s*\(\s*['\"]?(data:[^)'\"]*)['\"]?\s*\)", "\ue000($1)")
    html = sub(html, r"(?i)url\s*\([^)?#]*\.(?:png|gif|ico|jpg|jpeg|webp|svg)['\"]?\s*(?:[?#][^)]*)?\)", "\ue001")
    html = sub(html, r"url\s*\([^)]+\)", "url()")
    return F.replace(F.replace(html, F.lit("\ue000("), F.lit("url(")), F.lit("\ue001"), F.lit(f"url({CSS_PLACEHOLDER})"))


def valid(html: Column) -> Column:
    """False for pages that hold a phrase of an error page, in any case."""
    return ~F.exists(F.array(*map(F.lit, STOP_PHRASES)), lambda p: F.contains(F.lower(html), p))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def snippet_reasons(html: Column) -> Column:
    """Why a snippet is refused: another language's fence, fixed or absolute position, viewport size."""
    body = strip_fences(html)
    return F.filter(
        F.array(
            F.when(body.contains("```"), "code_fence"),
            F.when(body.rlike(r"(?i)position\s*:\s*(?:fixed|absolute)"), "positioned"),
            F.when(body.rlike(r"(?i)(?:^|[^a-z-])(?:min-)?(?:width|height)\s*:\s*100v[wh]"), "viewport_sized"),
        ),
        lambda x: x.isNotNull(),
    )


def unwrap_document(html: Column) -> Column:
    """The body's content of a whole document; a fragment stays."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)(?:</body>|$)", 1)
    bare = sub(sub(html, r"(?is)<head.*?</head>"), r"(?i)<!doctype[^>]*>|</?html[^>]*>|</?body[^>]*>")
    return F.trim(F.when(html.rlike(r"(?i)<body"), body).otherwise(bare))


def clean_page(html: Column) -> Column:
    """The corpus chain: elements, metas, comments, attributes, links, imports, blank lines."""
    html = remove_elements(html)
    html = remove_comments(remove_meta(html))
    html = remove_css_comments(html)
    for name in ("href", "srcset"):
        html = remove_attribute(html, name)
    return remove_blank_lines(remove_imports(blank_links(remove_link_elements(html))))


#: Element names of HTML 5. Fixed values.
TAGS = (
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption cite code col colgroup data datalist dd del details dfn dialog div dl dt em embed "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta meter nav noscript object ol optgroup "
    "option output p param picture pre progress q rp rt ruby s samp script section select small source span strong style sub summary sup svg table tbody td template textarea tfoot th thead "
    "time title tr track u ul var video wbr"
).split()


def opening_tags(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), lambda x: F.lower(x))
