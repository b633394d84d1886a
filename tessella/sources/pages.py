"""Documents from landed web pages: first-match cascades over HTML, links, pagination, item mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import classify, clean, urls
from tessella.operators.filters import announcement_url, news_url

#: Element and class cascades, tried in order; each is (element, class or None).
TITLE = [("h1", None), ("title", None)]
CONTENT = [("div", "article-content"), ("div", "content"), ("article", None), ("body", None)]
AUTHOR = [("span", "author"), ("div", "author")]
TIME = [("span", "time"), ("span", "date"), ("time", None)]
TAGS = [("div", "tags"), ("span", "tags")]
COMPANY = [("span", "company-name"), ("span", "stock-name"), ("span", "company")]
CODE = [("span", "stock-code"), ("span", "code"), ("span", "stock-symbol")]


def element(html: Column, tag: str, cls: str | None = None) -> Column:
    """Inner HTML of the first such element, null if there is none."""
    attr = f"\\s[^>]*class\\s*=\\s*[\"'][^\"']*\\b{cls}\\b[^\"']*[\"'][^>]*" if cls else "(?:\\s[^>]*)?"
    return F.nullif(F.regexp_extract(html, f"(?is)<{tag}{attr}>(.*?)</{tag}\\s*>", 1), F.lit(""))


def first_of(html: Column, cascade: list[tuple[str, str | None]]) -> Column:
    return F.coalesce(*[F.nullif(clean.clean_text(element(html, t, c)), F.lit("")) for t, c in cascade], F.lit(""))


def parse_pages(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """pages with title, content, publish_time, author, tags, domain; nothing leaves the JVM."""
    h = clean.strip_elements(F.col(html_col))
    body = F.coalesce(*[element(h, t, c) for t, c in CONTENT], h)
    in_url = clean.parse_timestamp(F.nullif(urls.date_in_url(F.col(url_col)), F.lit("")))
    return pages.withColumns({
        "title": first_of(h, TITLE), "content": clean.clean_content(body), "author": first_of(h, AUTHOR), "tags": clean.item_tags(first_of(h, TAGS)),
        "publish_time": F.coalesce(clean.parse_timestamp(F.nullif(first_of(h, TIME), F.lit(""))), in_url), "domain": urls.domain(F.col(url_col)),
    })


def parse_pages_html(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page text by a real HTML parser, Arrow-batched: for pages that patterns cannot read."""
    from collections.abc import Iterator
    from html.parser import HTMLParser

    import pandas as pd

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.skip, self.title, self.in_title = [], 0, "", False

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            self.in_title = tag == "title"
            if tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3"):
                self.parts.append("\n")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style") and self.skip > 0
            self.in_title = False

        def handle_data(self, data):
            if self.in_title:
                self.title += data
            elif not self.skip:
                self.parts.append(data)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for h in pdf[html_col].fillna(""):
                t = Text()
                t.feed(h)
                rows.append((" ".join(t.title.split()), "\n".join(x for x in (" ".join(line.split()) for line in "".join(t.parts).split("\n")) if x)))
            yield pdf.assign(parsed_title=[r[0] for r in rows], parsed_text=[r[1] for r in rows])

    schema = ", ".join(f"`{n}` {t}" for n, t in pages.dtypes) + ", parsed_title string, parsed_text string"
    return pages.mapInPandas(run, schema)


def news_items(parsed: DataFrame, url_col: str = "url") -> DataFrame:
    """Parsed pages that are news: admitted URL, title and content long enough, classified."""
    ok = (F.length("title") >= 10) & (F.length("content") >= 100)
    return parsed.filter(news_url(F.col(url_col)) & ok).withColumn("category", classify.news_category(F.col("title"), F.col("content")))


def announcement_items(parsed: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Parsed pages that are announcements, with company, code, id, type and importance."""
    u, t, c = F.col(url_col), F.col("title"), F.col("content")
    ok = (F.length("title") >= 5) & (F.length("content") >= 50)
    code = first_of(F.col(html_col), CODE)
    return parsed.filter(announcement_url(u) & ok).withColumns({
        "company_name": first_of(F.col(html_col), COMPANY), "stock_code": F.when(code != "", code).otherwise(urls.stock_code_in_url(u)), "announcement_id": urls.announcement_id_in_url(u),
        "announcement_type": classify.announcement_type(t, c), "is_important": classify.is_important_announcement(t, c),
    })


def page_links(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """url, link: the distinct admitted links of each page, relative ones joined to their host."""
    link = F.col("link")
    host = F.regexp_extract(F.col(url_col), "^(https?://[^/]+)", 1)
    x = pages.select(F.col(url_col), F.explode(urls.links(F.col(html_col))).alias("link"))
    return x.select(url_col, F.when(link.startswith("/"), F.concat(host, link)).otherwise(link).alias("link")).dropDuplicates()


def next_pages(pages: DataFrame, limit: int = 5, url_col: str = "url") -> DataFrame:
    return pages.select(F.col(url_col), F.explode(urls.page_numbers(F.col(url_col), limit)).alias("page_url"))


def to_wire(items: DataFrame, kind: str = "news") -> DataFrame:
    """Crawled items in the ingest form."""
    title, url = F.col("title"), F.col("url")
    crawler = F.map_from_arrays(F.array(F.lit("crawler"), F.lit("domain"), F.lit("language")), F.array(F.lit("tessella"), urls.domain(url), F.lit("zh")))
    return items.withColumns({"id": urls.item_id(url, title), "type": F.lit(kind), "content_length": F.length("content"), "metadata": crawler})
