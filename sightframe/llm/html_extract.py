"""Main text of web pages by wrappers: union-free regular expressions of a host's pages, inferred by aligning them.

Every page is read as a stream of structure tokens: its elements, with class, id and role, and text slots. Adjacent
copies of the same tokens fold into repeated groups. The streams of a host are aligned one after another with its
wrapper; what only one side has becomes optional, so the wrapper stays free of unions and has a place for every token
of all pages seen. Distinct streams are counted before they are shuffled, and are aligned in groups of about GROUP, then
the groups' wrappers are, and so on, so no task holds more of a host than that.

Every page is then matched with its host's wrapper, and what its pages have in each text slot is counted: characters,
how many of them are in links, and how many different texts in how many different articles. So the wrapper tells the
template, whose slots have the same text in different articles, from the data. The element of the wrapper that holds
the data is the article: an ``article`` or ``main`` with a fair share of it, or else the smallest element with most of
it. Elements that HTML or their name declare to be no part of it are set aside; where a name may mean either, or inside an
article its subject, the slots decide, and what readers write is told by repeated groups below a name for it. What remains of the article's slots is kept, and a page's main text is what it has at the kept slots' places.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .text import give_back
from .url_filter import host_of

#: Streams or wrappers that are aligned in one task, about; matched streams that a task remembers.
GROUP, REMEMBERED = 64, 4096
#: Least share of the data of an article or main element; of any other one.
DECLARED, MOST = 0.2, 0.7
#: From this share of its text in links, or with different texts in less than this share of articles, a block is layout.
HALF = 0.5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|title|textarea|svg|iframe|select|button|annotation(?:-xml)?)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag of the key closes an open element of these, up to the nearest of the bounds.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_ASIDE = frozenset("nav aside footer form head dialog menu".split())
_ASIDE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Names of elements that are no part of an article.
_ASIDE_NAME = re.compile(r"(?:^|[\s._-])(?:ads?|adverts?|advertisements?|advertising|sponsored|cookies?|consent|popup|modal|newsletter|subscri(?:be|ption)|sign-?up|login|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|footer|masthead|site-?header|comments?|comment-?list|disqus)(?:$|[\s._-])", re.I)
#: Names that may mean either; only where the element's slots are layout is it set aside.
_MAYBE_NAME = re.compile(r"(?:^|[\s._-])(?:sponsors?|promo(?:tion)?s?|banner|notices?|alert|page-?header|respond|discussion|replies|share|sharing|social|related|recommended|widget|tags?|tags?-?list)(?:$|[\s._-])", re.I)
#: Names that inside an article may also be its subject; there they are set aside only where the slots say so too.
_TOPIC_NAME = re.compile(r"(?:^|[\s._-])(?:menu|cookies?|login|advertising)(?:$|[\s._-])", re.I)
#: Names of what readers write, if groups repeat below them.
_READERS = re.compile(r"(?:^|[\s._-])(?:comments|feedback|reviews?|responses?|opinions)(?:$|[\s._-])", re.I)
#: Elements of text, which names don't set aside and which are no article by themselves.
_TEXT = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 blockquote pre caption figcaption summary td th tr tbody thead tfoot address html body".split())
#: Elements whose adjacent copies fold though they have no name.
_FOLDS = _TEXT | {"article", "figure", "details", "center", "dir"}


class Page:
    """A page's tokens, and of each text slot among them the text and how many of its characters are in links."""

    def __init__(self, html: str) -> None:
        self.tokens: list[str] = []
        self.blocks: list[tuple[str, int]] = []
        stack: list[tuple[str, str]] = []  # tag, name
        text: list[str] = []
        linked: list[str] = []
        links: list[int] = []  # the open link; one that is never closed ends with its block

        def flush() -> None:
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    self.blocks.append((joined, min(len(joined), len(" ".join("".join(linked).split())))))
                    self.tokens.append("#")
                text.clear()
                linked.clear()

        def pop_to(at: int) -> None:
            while len(stack) > at:
                tag, name = stack.pop()
                if tag in _BLOCK:
                    flush()
                    links.clear()
                    self.tokens.append("/" + name)

        def add(part: str) -> None:
            text.append(part)
            if links:
                linked.append(part)

        for m in _TOKEN.finditer(html):
            whole = m[0]
            if m[3] is None:
                if whole[0] != "<" or whole == "<":
                    add(unescape(whole))
                elif whole.startswith("<![CDATA["):
                    add(whole[9:].removesuffix("]]>"))
                continue
            tag = m[3].lower()
            if m[2]:
                if tag == "a":
                    links.clear()
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if at is not None:
                    pop_to(at)
                elif tag in _BLOCK:
                    flush()
                continue
            if tag in ("br", "wbr", "hr"):
                if tag == "hr":
                    flush()
                elif tag == "br":
                    add(" ")
                continue
            if tag in _VOID or m[4].rstrip().endswith("/") and tag not in _BLOCK:
                continue
            if tag == "a" and "href" in m[4].lower():
                links[:] = [1]
            if tag not in _BLOCK:
                stack.append((tag, tag))
                continue
            flush()
            last = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _BLOCK), None)
            if last is not None and stack[last][0] == "p":
                pop_to(last)
            if tag in _CLOSES:
                kinds, bounds = _CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in bounds:
                        break
                    if stack[i][0] in kinds:
                        pop_to(i)
                        break
            marks = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[4])} if "=" in m[4] else {}
            label = ".".join(x for x in (marks.get("class"), marks.get("id")) if x)
            name = tag + ("." + re.sub(r"[\s>@]+", ".", re.sub(r"\d+", "0", label)) if label else "") + ("@" + marks["role"].strip().lower() if marks.get("role") else "")
            stack.append((tag, re.sub(r"\s+", ".", name)))
            self.tokens.append("<" + stack[-1][1])
        flush()
        pop_to(0)

    def stream(self) -> tuple[list[str], list[int]]:
        """The folded tokens, and for each block the place of its slot among them."""
        folded = fold(self.tokens)
        slot = [0] * len(self.blocks)
        for i, (_, own) in enumerate(folded):
            for b in own:
                slot[b] = i
        return [t for t, _ in folded], slot


def fold(tokens: list[str]) -> list[tuple[str, list[int]]]:
    """Adjacent copies of an element, or of a text slot, as one with a plus; with the numbers of the blocks at each slot.

    Containers without a name don't fold: they are told apart by their order.
    """
    out: list[tuple[str, list[int]]] = []
    starts: list[int] = []
    block = 0
    for t in tokens:
        if t == "#":
            if out and out[-1][0] in ("#", "#+"):
                out[-1] = "#+", [*out[-1][1], block]
            else:
                out.append((t, [block]))
            block += 1
        elif t[0] == "<":
            starts.append(len(out))
            out.append((t, []))
        else:
            a = starts.pop()
            out.append((t, []))
            n = len(out) - a
            if a >= n and (t[1:] in _FOLDS or "." in t) and all(x.rstrip("+") == y.rstrip("+") for (x, _), (y, _) in zip(out[a - n : a], out[a:])):
                both = [(x if x == y else x.rstrip("+") + "+", [*p, *q]) for (x, p), (y, q) in zip(out[a - n : a], out[a:])]
                out[a - n :] = [*both[:-1], (t.rstrip("+") + "+", [])]
    return out


def labelled(stream: list[str]) -> list[list]:
    """Items [token with the path of elements around it, optional, repeated] of a stream."""
    out, path = [], []
    for t in stream:
        kind, name = t[0], t.rstrip("+")[1:]
        if kind == "<":
            path.append(name)
        out.append([kind + ">".join(path), False, t.endswith("+")])
        if kind == "/":
            path.pop()
    return out


def align(wrapper: list[list], stream: list[list]) -> list[list]:
    """The wrapper that matches both: items [token, optional, repeated]; what one side lacks becomes optional."""
    out: list[list] = []
    for kind, a0, a1, b0, b1 in SequenceMatcher(None, [w[0] for w in wrapper], [s[0] for s in stream], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [[x[0], x[1] or y[1], x[2] or y[2]] for x, y in zip(wrapper[a0:a1], stream[b0:b1])]
        else:
            out += [[x[0], True, x[2]] for x in wrapper[a0:a1]] + [[y[0], True, y[2]] for y in stream[b0:b1]]
    return out


def merged(wrappers: Iterator[list[list]]) -> list[list]:
    out: list[list] | None = None
    for w in wrappers:
        out = w if out is None else out if w == out else align(out, w)
    return out or []


def places(wrapper: list[list], stream: list[str]) -> list[int]:
    """For each token of a stream its place in the wrapper; one that alignment leaves out goes to the first like it, or to none (-1)."""
    items, known = [s[0] for s in labelled(stream)], [w[0] for w in wrapper]
    out = [-1] * len(items)
    for a, b, n in SequenceMatcher(None, known, items, autojunk=False).get_matching_blocks():
        out[b : b + n] = range(a, a + n)
    return [p if p >= 0 else known.index(t) if t in known else -1 for p, t in zip(out, items)]


def _tag(name: str) -> str:
    return re.split(r"[.@]", name, maxsplit=1)[0]


def _said(name: str) -> str:
    """Class and id of an element."""
    return name.partition("@")[0].partition(".")[2]


def _outside(path: str) -> bool:
    """Whether an element on the path is declared to be no part of an article."""
    within = False
    for name in path.split(">"):
        tag, role = _tag(name), name.partition("@")[2]
        if tag in _ASIDE or tag == "header" and not within or role in _ASIDE_ROLE:
            return True
        said = _said(name)
        if tag not in _TEXT and _ASIDE_NAME.search(_TOPIC_NAME.sub(" ", said) if within else said):
            return True
        within = within or tag in ("article", "main")
    return False


def kept_slots(wrapper: list[list], seen: dict[int, tuple[int, int, int, int]]) -> list[int]:
    """The slots of the article: places in the wrapper, of whose slots the pages' articles, texts, characters and characters in links are given."""
    paths: list[str] = []
    inside: dict[int, list[int]] = {}
    stack: list[int] = []
    groups: set[int] = set()  # elements with repeated elements below them
    for i, (token, _, again) in enumerate(wrapper):
        kind, path = token[0], token[1:]
        around = path.rpartition(">")[0] if kind == "<" else path
        while stack and paths[stack[-1]] != around and not around.startswith(paths[stack[-1]] + ">"):
            stack.pop()
        if kind == "<":
            paths.append(path)
            stack.append(len(paths) - 1)
        elif kind == "/" and stack and paths[stack[-1]] == path:
            stack.pop()
            if again:
                groups |= set(stack)
        elif kind == "#" and i in seen:
            inside[i] = list(stack)
    of: list[list[int]] = [[] for _ in paths]
    for i, elements in inside.items():
        for e in elements:
            of[e].append(i)
    varied = {i: (texts - 1) / (articles - 1) if articles > 1 else 1.0 for i, (articles, texts, _, _) in seen.items()}

    def layout(e: int) -> bool:
        """The element's text is mostly links, or the same in most articles; and both where its name says nothing."""
        name = paths[e].rpartition(">")[2]
        chars, links = (sum(seen[i][k] for i in of[e]) for k in (2, 3))
        linked, fixed = links >= HALF * chars, all(varied[i] < HALF for i in of[e])
        if _TOPIC_NAME.search(_said(name)) and max(seen[i][0] for i in of[e]) < 2:
            return True  # one article tells nothing of its host's slots, so the name decides
        if _READERS.search(_said(name)) and e in groups:
            return True
        return linked or fixed if _MAYBE_NAME.search(_said(name)) or _TOPIC_NAME.search(_said(name)) else linked and fixed

    aside = {e for e in range(len(paths)) if of[e] and _tag(paths[e].rpartition(">")[2]) not in _TEXT and layout(e)}
    slots = [i for i, elements in inside.items() if not aside & set(elements) and not _outside(wrapper[i][0][1:])]
    mass = {i: min(varied[i], 1.0) * (seen[i][2] - seen[i][3]) for i in slots}
    if sum(mass.values()) <= 0:
        mass = {i: float(seen[i][2]) for i in slots}
    held = [sum(mass.get(i, 0.0) for i in of[e]) for e in range(len(paths))]
    total = sum(mass.values())
    main = None
    for tag in ("article", "main"):
        by_path: dict[str, float] = {}
        for e, path in enumerate(paths):
            if _tag(path.rpartition(">")[2]) == tag:
                by_path[path] = by_path.get(path, 0.0) + held[e]
        best = max(by_path, key=lambda p: (by_path[p], -len(p), p), default=None)
        if best is not None and by_path[best] >= DECLARED * total and by_path[best] > 0:
            main = {e for e, path in enumerate(paths) if path == best}
            break
    if main is None:
        fits = [e for e in range(len(paths)) if held[e] >= MOST * total and _tag(paths[e].rpartition(">")[2]) not in _TEXT]
        main = {max(fits, key=lambda e: (paths[e].count(">"), held[e], -e))} if fits else None
    kept = [i for i in slots if main is None or main & set(inside[i])]
    head = lambda i: "h1" in map(_tag, wrapper[i][0][1:].split(">"))
    if kept and not any(map(head, kept)):  # the title above the article is part of it
        kept = [i for i in slots if i < kept[0] and head(i)][-1:] + kept
    return kept


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as their stream, with the text, links and slot of every block."""
    for batch in batches:
        streams, texts, links, slots = [], [], [], []
        for html in batch.column(3).to_pylist():
            page = Page(html or "")
            stream, slot = page.stream()
            streams.append("\n".join(stream))
            texts.append([t for t, _ in page.blocks])
            links.append([n for _, n in page.blocks])
            slots.append(slot)
        kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        made = [pa.array(x, k) for x, k in zip((streams, texts, links, slots), kinds)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *made], names=["page_id", "url", "host", "stream", "texts", "links", "slots"])
        give_back()


def _label_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [json.dumps(labelled(s.split("\n") if s else [])) for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "wrapper"])


def _infer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(merged(json.loads(x) for x in sorted(rows["wrapper"])))]})


def wrappers(read: DataFrame) -> DataFrame:
    """host and wrapper (JSON items of token, optional, repeated) for every host of ``read`` (host, stream)."""
    now = materialize(read.select("host", "stream").distinct().mapInArrow(_label_rows, "host string, wrapper string"))
    while True:
        counts = materialize(now.groupBy("host").agg(F.ceil(F.count("*") / GROUP).alias("parts"), F.count("*").alias("n")))
        if counts.where("n > 1").isEmpty():
            return now
        part = F.pmod(F.xxhash64("wrapper"), F.col("parts"))
        now = materialize(now.join(counts, "host").withColumn("part", part).groupBy("host", "part").applyInPandas(_infer, "host string, wrapper string"))


class Matcher:
    """Places of streams in wrappers, and which slots are declared to be outside; those matched last remembered."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[list[int], list[bool]]] = {}

    def __call__(self, wrapper: str, stream: str) -> tuple[list[int], list[bool]]:
        key = xxhash.xxh3_128_digest(f"{wrapper}\n{stream}")
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            tokens = stream.split("\n") if stream else []
            self.known[key] = places(json.loads(wrapper), tokens), [t[0] == "#" and _outside(t[1:]) for t, _, _ in labelled(tokens)]
        return self.known[key]


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each page has in each slot of its host's wrapper: a hash of the text and one of the page's article, characters, and those in links."""
    match = Matcher()
    for batch in batches:
        out: list[tuple] = []
        for host, stream, texts, links, slots, wrapper in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if not texts:
                continue
            (at, outside), by = match(wrapper, stream), {}
            # Articles are told apart by the two longest blocks that may be theirs: one may be a notice that all pages have.
            own = [t for t, slot in zip(texts, slots) if not outside[slot]] or texts
            article = xxhash.xxh64_intdigest("\n".join(sorted(own, key=lambda t: (-len(t), t))[:2])) >> 1
            for text, n, slot in zip(texts, links, slots):
                by.setdefault(at[slot], []).append((text, n))
            out += [(host, k, article, xxhash.xxh64_intdigest("\n".join(t for t, _ in own)) >> 1, sum(len(t) for t, _ in own), sum(n for _, n in own)) for k, own in by.items()]
        if out:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["host", "slot", "article", "said", "chars", "links"])


def _choose_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for wrapper, seen in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kept.append(kept_slots(json.loads(wrapper), {s["slot"]: (s["articles"], s["texts"], s["chars"], s["links"]) for s in seen or ()}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.int32()))], names=["host", "wrapper", "kept"])


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    match = Matcher()
    for batch in batches:
        said = []
        for stream, texts, links, slots, wrapper, kept in zip(*(batch.column(i).to_pylist() for i in range(2, 8))):
            said.append(text_of(stream, texts, links, slots, match(wrapper, stream)[0], frozenset(kept)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array([len(t) for t in said], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def text_of(stream: str, texts: list[str], links: list[int], slots: list[int], at: list[int], kept: frozenset[int]) -> str:
    """The blocks of a page at the kept places of its host's wrapper.

    A page that has none of them, though it has text, is of another kind than its host's articles and is a host of its own.
    """
    out = [t for t, s in zip(texts, slots) if at[s] in kept]
    if not out and texts and kept:
        alone = labelled(stream.split("\n"))
        seen: dict[int, tuple[int, int, int, int]] = {}
        for t, n, s in zip(texts, links, slots):
            _, _, chars, linked = seen.get(s, (1, 1, 0, 0))
            seen[s] = 1, 1, chars + len(t), linked + n
        own = set(kept_slots(alone, seen))
        out = [t for t, s in zip(texts, slots) if s in own]
    return "\n\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Null and empty pages have empty text. A null URL, or one without ``://``, belongs to a host of its own. Rows that
    repeat and null ids give a row each; an empty table gives an empty result; other columns are not read.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    kind = dict(pages.dtypes)["page_id"]
    read = materialize(pages.mapInArrow(_read_rows, f"page_id {kind}, url string, host string, stream string, texts array<string>, links array<int>, slots array<int>"))
    known = wrappers(read)
    slots = read.join(known, "host").select("host", "stream", "texts", "links", "slots", "wrapper").mapInArrow(_slot_rows, "host string, slot int, article long, said long, chars long, links long")
    seen = slots.groupBy("host", "slot").agg(F.approx_count_distinct("article").alias("articles"), F.approx_count_distinct("said").alias("texts"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    seen = seen.groupBy("host").agg(F.collect_list(F.struct("slot", "articles", "texts", "chars", "links")).alias("seen"))
    chosen = materialize(known.join(seen, "host", "left").select("host", "wrapper", "seen").mapInArrow(_choose_rows, "host string, wrapper string, kept array<int>"))
    rows = read.join(chosen, "host").select("page_id", "url", "stream", "texts", "links", "slots", "wrapper", "kept")
    return rows.mapInArrow(_text_rows, f"page_id {kind}, url string, text string, n_chars long")
