"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

Pass 1 turns every page into tokens: container tags with their path of enclosing containers, and text chunks
with theirs. A token's occurrence vector holds its count on every page of its host; the vector is kept as an
XOR of hashes of (row, count), a combinable aggregate over all pages, so no host is ever collected and a host
with a third of all pages is an ordinary group. Rows are told apart by their place, so repeated rows don't
cancel. Tokens of one host with equal vectors form an equivalence
class. A class is valid if it has at least MIN_TOKENS tokens and covers at least MIN_SHARE of the host's pages
(and MIN_PAGES of them). Valid classes nest: a token belongs to the template only if the container around it is itself a
token of a valid class, or the page. Its text chunks are
boilerplate; its containers delimit slots, of which those under an article or main element, else those that
hold more running text than links, are the host's main slots.

Pass 2 reads every page again and takes the text of the main slots, without elements that are boilerplate by
kind (menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) and
without the template's text chunks, and inside article and main elements without blocks made of such chunks alone.
Those stay only on a page of whose main text they make up more than half, as where a host's pages are copies of each other. Pages that lack their host's main slots, and hosts with
too few pages for a template, fall back to their own article or main element, else to all that is left.

Blocks are cut at block-level tags; character references are decoded, white space becomes one space, blocks
join with an empty line. Defined cases: null html is empty and gives an empty text; a null or odd url belongs
to the host ''; broken markup is read as it stands (unclosed elements end with their parent); repeated rows
are separate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.bpe import texts_of
from keystrata.llm.common import ROW_KEY, materialize, passing_tables, row_keyed, table

MIN_PAGES, MIN_SHARE, MIN_TOKENS = 3, 0.6, 3
BROADCAST_HOSTS = 200_000
SALT = 64

# kinds of element
SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "head", "select", "button", "textarea", "object", "canvas"}
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog"} | SKIPPED
MAIN = {"article", "main"}
CONTAINERS = BOILER | MAIN | {"html", "body", "div", "section", "header", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "figure", "blockquote", "details", "fieldset", "center"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "address", "hr", "figcaption", "summary", "caption", "title"}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:nav(?:bar|igation)?|menu|sidebar|side|footer|header|masthead|ads?|advert\w*|sponsor\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|promo\w*"
    r"|comments?|disqus|replies|share|sharing|social|related|recommended|subscribe|newsletter|signup|breadcrumbs?|login|search|widget|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
KIND_TEXT, KIND_TAG, KIND_MAIN, KIND_BOILER = 0, 1, 3, 5


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].lower()


def chunks(page: str) -> Iterator[tuple[str, object]]:
    """("open", (path, main, boiler, path around it)), ("text", (raw, path stack, in a link)), ("cut", None) and ("gap", None) events.

    Path stack: [(tag, path hash, under a main element, boilerplate)] of the open containers.
    """
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    link = 0
    for m in TOKEN.finditer(page):
        s = m.group()
        if s[0] != "<" or s == "<":
            yield "text", (s, stack, link > 0)
            continue
        tag = m.group(3)
        if tag is None:
            if m.group(1):
                yield "cut", None
            continue
        tag = tag.lower()
        if m.group(2):
            if tag == "a":
                link = 0
            if any(x[0] == tag for x in stack):
                while stack[-1][0] != tag:
                    stack.pop()
                stack.pop()
            if tag in BLOCKS:
                yield "cut", None
            continue
        if tag == "br":
            yield "gap", None
            continue
        if tag == "a":
            link = 1
        if tag in BLOCKS:
            yield "cut", None
            if stack[-1][0] in ("p", "li"):
                stack.pop()
        named = " ".join(a or b or c for _, a, b, c in ATTR.findall(m.group(4))) if m.group(4) else ""
        odd = bool(named and tag not in MAIN and tag not in ("html", "body") and NAMED.search(named))
        if tag in CONTAINERS or (odd and tag in ("p", "li", "span")):
            _, outer, main, boiler = stack[-1]
            path = xxhash.xxh64_intdigest(f"{outer}/{tag}.{named}") >> 1
            boiler = boiler or tag in BOILER or odd or (tag == "header" and not main)
            main = main or tag in MAIN
            if not s.endswith("/>"):
                stack.append((tag, path, main, boiler))
            yield "open", (path, main, boiler, outer)


def page_tokens(page: str) -> dict[int, list[int]]:
    """token -> [count, kind, characters, characters in links, container around it] of one page; token 0 stands for the page."""
    out: dict[int, list[int]] = {0: [1, KIND_TAG, 0, 0, 0]}
    for event, x in chunks(page):
        if event == "open":
            path, main, boiler, outer = x
            out.setdefault(path, [0, KIND_BOILER if boiler else KIND_MAIN if main else KIND_TAG, 0, 0, outer])[0] += 1
        elif event == "text":
            raw, stack, link = x
            text = SPACE.sub(" ", raw).strip()
            if text:
                key = xxhash.xxh64_intdigest(f"{stack[-1][1]}#{text}") >> 1
                out.setdefault(key, [0, KIND_TEXT, 0, 0, stack[-1][1]])[0] += 1
                if stack[-1][1] in out:
                    out[stack[-1][1]][2] += len(text)
                    out[stack[-1][1]][3] += len(text) * link
    return out


def main_text(page: str, slots: set[int], boilerplate: set[int]) -> str:
    """The text of a page: of its host's main slots, else of its own main element, else of what isn't boilerplate."""
    found: list[list[tuple[int, str, bool]]] = [[]]
    for event, x in chunks(page):
        if event == "text":
            raw, stack, _ = x
            tag, path, main, boiler = stack[-1]
            if boiler:
                continue
            under = 2 if slots and any(p in slots for _, p, _, _ in stack) else 1 if main else 0
            dealt = bool(boilerplate) and xxhash.xxh64_intdigest(f"{path}#{SPACE.sub(' ', raw).strip()}") >> 1 in boilerplate
            if dealt and not main:
                continue
            found[-1].append((under, entities.unescape(raw), dealt))
        elif event == "gap":
            if found[-1]:
                found[-1].append((found[-1][-1][0], " ", found[-1][-1][2]))
        elif event == "cut" and found[-1]:
            found.append([])
    # inside main only blocks that are template text throughout: a word between tags may recur by chance
    whole = [all(x[2] or x[1].isspace() for x in block) for block in found]
    shared = sum(len(SPACE.sub(" ", t).strip()) for block, w in zip(found, whole) if w for _, t, _ in block)
    own = sum(len(SPACE.sub(" ", t).strip()) for block in found for u, t, _ in block if u)
    if shared * 2 <= own:
        found = [block for block, w in zip(found, whole) if not w]
    best = max((u for block in found for u, t, _ in block if not t.isspace()), default=0)
    texts = (SPACE.sub(" ", "".join(t for u, t, _ in block if u >= best)).strip() for block in found)
    return "\n\n".join(t for t in texts if t)


COLUMNS = ("token", "vector", "df", "total", "kind", "chars", "links", "outer")


def host_tokens(keyed: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """host and COLUMNS, over all pages of each host; `keyed` holds ROW_KEY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("host", pa.string())] + [(c, pa.int64()) for c in COLUMNS])
        for batch in batches:
            acc: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0, 0, 0])
            for file, row, url, page in zip(*(batch.column(c).to_pylist() for c in range(3)), texts_of(batch.column(3))):
                host = host_of(url)
                for token, (count, kind, chars, links, outer) in page_tokens(page).items():
                    a = acc[(host, token)]
                    a[0] ^= xxhash.xxh64_intdigest(f"{file}:{row}:{count}") >> 1
                    a[1] += 1
                    a[2] += count
                    a[3] = max(a[3], kind)
                    a[4] += chars
                    a[5] += links
                    a[6] = outer
            cols = [[k[0] for k in acc], [k[1] for k in acc]] + [[a[i] for a in acc.values()] for i in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    slim = keyed.select(*ROW_KEY, F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    rows = slim.mapInArrow(run, "host string, " + ", ".join(f"{c} long" for c in COLUMNS))
    return rows.groupBy("host", "token").agg(
        F.bit_xor("vector").alias("vector"), F.sum("df").alias("df"), F.sum("total").alias("total"), F.max("kind").alias("kind"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
        F.max("outer").alias("outer"),
    )


def templates(tokens: DataFrame) -> DataFrame:
    """(host, slots, boilerplate): the main slots' paths and the template's text chunks of each host."""
    size = tokens.filter("token = 0").select("host", F.col("df").alias("pages"))
    often = tokens.join(size, "host").filter((F.col("df") >= MIN_PAGES) & (F.col("df") >= MIN_SHARE * F.col("pages")))
    classes = often.groupBy("host", "vector", "df", "total").agg(F.count(F.lit(1)).alias("tokens"))
    valid = often.join(classes.filter(F.col("tokens") >= MIN_TOKENS).select("host", "vector", "df", "total"), ["host", "vector", "df", "total"])
    around = valid.filter(F.col("kind") != KIND_TEXT).select("host", F.col("token").alias("outer"))
    valid = valid.join(around.unionByName(size.select("host", F.lit(0).cast("long").alias("outer"))).distinct(), ["host", "outer"], "left_semi")
    has_main = F.max(F.when(F.col("kind") == KIND_MAIN, 1).otherwise(0))
    picked = valid.filter("token <> 0").groupBy("host").agg(
        has_main.alias("m"),
        F.collect_set(F.when(F.col("kind") == KIND_MAIN, F.col("token"))).alias("inner"),
        F.collect_set(F.when((F.col("kind") == KIND_TAG) & (F.col("chars") > 2 * F.col("links")), F.col("token"))).alias("running"),
        F.collect_set(F.when(F.col("kind") == KIND_TEXT, F.col("token"))).alias("boilerplate"),
    )
    return picked.select("host", F.when(F.col("m") == 1, F.col("inner")).otherwise(F.col("running")).alias("slots"), "boilerplate")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """`id_col`, `url_col`, text, n_chars of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set[int], set[int]]] = {}
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                out, size, start = [], 0, at
                for host, page, slots, boiler in zip(batch.column(3).slice(at), texts_of(batch.column(2).slice(at)), batch.column(4).slice(at), batch.column(5).slice(at)):
                    h = host.as_py()
                    if h not in known:
                        if len(known) > 5000:
                            known.clear()
                        known[h] = set(slots.as_py() or ()), set(boiler.as_py() or ())
                    out.append(main_text(page, *known[h]))
                    size += len(out[-1])
                    at += 1
                    if size > 2_000_000:
                        break
                n = at - start
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [id_col, url_col, "text", "n_chars"])

    with passing_tables(pages.sparkSession):
        tokens = materialize(host_tokens(row_keyed(pages, url_col, html_col), url_col, html_col), "host-tokens")  # pages are parsed for it once
        found = materialize(templates(tokens), "templates", keep=True)
    slim = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).cast("string").alias("__url"), F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    host = F.when(F.instr("__url", "://") > 0, F.lower(F.substring_index(F.regexp_extract(F.regexp_replace("__url", "^.*?://", ""), "^[^/?#]*", 0), "@", -1)))
    slim = slim.withColumn("__host", F.coalesce(host, F.lit("")))
    entries = found.select(F.coalesce(F.sum(F.size("slots") + F.size("boilerplate") + 4), F.lit(0))).first()[0]
    if entries <= broadcast_hosts:  # 8 bytes an entry
        joined = slim.join(F.broadcast(found), slim["__host"] == found["host"], "left")
    else:
        salted = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        slim = slim.withColumn("__slim_salt", F.pmod(F.xxhash64("__id", "__url"), F.lit(SALT)).cast("int"))
        joined = slim.join(salted, (slim["__host"] == salted["host"]) & (slim["__slim_salt"] == salted["__salt"]), "left")
    return joined.select("__id", "__url", "__html", "__host", "slots", "boilerplate").mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
