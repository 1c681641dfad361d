"""Main text of web pages.

The markup says first what is no text: scripts, styles, forms, menus, headers, footers, sidebars, and elements whose class, id or
role names them as adverts, notices, comments and the like (a whole name such as ``sidebar``, one that begins with it as
``ad-slot``, or one of a place as ``site-footer``; ``has-sidebar`` names none). What an article container (``article``, else ``main``)
holds besides is the text the host then decides. A form or a named element around the container drops
what else it holds, and the container only if there is another one. Of several articles those under a quarter of the longest are teasers.

The host decides by its repeated runs: the words of its pages are laid end to end, suffixes are sorted by prefix doubling, and runs of
``RUN`` words are told by their ranks. Pages of a host are dealt into groups of about ``GROUP`` by a hash, so that no host meets in one
task whole.

In containers a run that at least half of the distinct texts of the host hold, of ``TEXTS`` or more, is a notice of the site that no markup
names. A block goes if notices cover all its words; passages that fewer articles share stay, and so does a page that would lose over
``LOSS`` of its words, as it is one of many versions of a text. A run that half of the host's texts hold is held by half of a group's: each group states
those, and they are then counted over all pages of the host.

On pages without a container a run that occurs on two distinct ones is boilerplate. Covered words
go, unique runs stay. Where a host has several groups, each first states the digests of its runs, once per group; those that several groups
state are handed to these groups, so that a run counts as repeated wherever its pages lie.

Blocks are parted by block-level tags; ``br`` is white space. White space inside a block becomes one space, character
references are decoded, blocks are joined by one newline. Null and empty pages have an empty text. Pages whose url is null or names
no host are taken for pages of one host. A page of a repeated
row (same page_id and url) is not distinct from its copy. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlytics.llm.common import materialise, sorted_groups, with_text_columns

RUN = 8
GROUP = 1000
TEXTS = 8  # distinct texts of a host from which on it can tell a notice in them
LOSS = 0.25  # of the words of a text, the most that can be notices
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead "
    "tr ul".split()
)
_DROPPED = frozenset(
    "aside audio button canvas dialog embed fieldset footer form head header iframe input map menu nav noscript object option "
    "search select svg template textarea title video".split()
)
_NAMES = frozenset(
    "ad ads adsbygoogle advert advertisement adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright dialog disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter notice notification "
    "pagination popup promo promoted recommended related reply replies share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget".split()
)
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# of two-part names: a notice of the site, the comments of a post; but the header of an article is its title
_PLACES = frozenset("site page post article main entry global top bottom left right content blog web primary secondary".split())
_TITLED = frozenset(f"{a}-header" for a in ("post", "article", "entry"))
_HARD = _DROPPED - {"form"}  # what is never around the main text; whole pages may lie in a form
# in the order of the page: a script inside a comment is comment, a comment mark inside a script is script
_SKIPPED = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
TEASER = 0.25  # an article beside one that is so much longer is a teaser


def _named(attributes: str) -> bool:
    """Whether class, id or role name something other than the main text."""
    for kind, *values in _ATTRIBUTE.findall(attributes):
        for name in "".join(values).split():
            if kind.lower() == "role":
                if name.lower() in _ROLES:
                    return True
                continue
            parts = [x for x in re.split(r"[^a-z0-9]+", _HUMP.sub("-", name).lower()) if x]
            if not parts or "-".join(parts) in _TITLED:
                continue
            if parts[0] in _NAMES or (parts[-1] in _NAMES and _PLACES.issuperset(parts[:-1])):
                return True
    return False


@dataclass(frozen=True)
class Block:
    """A block of text, and where it stands."""

    text: str
    zone: int  # 2 inside an article, 1 inside main, 0 elsewhere
    box: int  # the number of this article or main
    doubtful: bool  # whether that lies in an element whose name says it is no main text


def parse(page: str) -> list[Block]:
    """The blocks of a page in order, without what is no text. An element around an article drops the rest of its text, not the article."""
    page = _SKIPPED.sub(lambda m: " " if m[1] else "", page)
    blocks: list[Block] = []
    parts: list[str] = []
    dropped = hard = zone = box = boxes = 0
    doubtful = False
    open_tags: list[tuple[str, bool, bool, tuple | None]] = []  # name, whether it drops its text, and never holds an article, state outside

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append(Block(text, zone, box, doubtful))

    def close(index: int) -> None:
        nonlocal dropped, hard, zone, box, doubtful
        for _, drops, is_hard, outside in reversed(open_tags[index:]):
            if outside is not None:
                dropped, hard, zone, box, doubtful = outside
            dropped -= drops
            hard -= is_hard
        del open_tags[index:]

    at = 0
    for tag in _TAG.finditer(page):
        if not dropped and tag.start() > at:
            parts.append(page[at : tag.start()])
        at = tag.end()
        name = tag[2].lower()
        if name in _BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if tag[1]:
            for index in range(len(open_tags) - 1, -1, -1):
                if open_tags[index][0] == name:
                    close(index)
                    break
                if name not in _BLOCK and open_tags[index][0] in _BLOCK:
                    break  # an inline tag does not end a block
        elif name not in _VOID and not tag[3].endswith("/>"):
            if name in _BLOCK:  # a block ends an open paragraph, a list item or cell the one before it
                for index in range(len(open_tags) - 1, -1, -1):
                    outer = open_tags[index][0]
                    if outer == "p" or (outer == name and name in ("li", "dt", "dd", "td", "th", "tr")):
                        close(index)
                        break
                    if outer in _BLOCK:
                        break
            named = "=" in tag[3] and name not in ("html", "body") and _named(tag[3])
            own = 2 if name == "article" else 1 if name == "main" else 0
            if own > zone and not hard:
                outside = (dropped, hard, zone, box, doubtful)
                open_tags.append((name, False, False, outside))
                boxes += 1
                doubtful = doubtful or dropped > 0 or named
                dropped, zone, box = 0, own, boxes
            else:
                drops = name in _DROPPED or named
                open_tags.append((name, drops, name in _HARD, None))
                dropped += drops
                hard += name in _HARD
    if not dropped:
        parts.append(page[at:])
    flush()
    return blocks


def contained(blocks: Sequence[Block]) -> str:
    """The blocks of the innermost kind of container that has any, of those first that stand in no doubt; of several the long ones."""
    if not blocks:
        return ""
    rank = lambda b: (b.zone > 0, not b.doubtful, b.zone)
    best = max(map(rank, blocks))
    chosen = [b for b in blocks if rank(b) == best]
    letters: dict[int, int] = {}
    for b in chosen:
        letters[b.box] = letters.get(b.box, 0) + len(b.text)
    least = TEASER * max(letters.values())
    return "\n".join(b.text for b in chosen if letters[b.box] >= least)


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The rank of every suffix by its first ``depth`` tokens (a power of two or more), by prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < depth:
        step = min(length, depth - length)
        later = np.full(len(rank), -1, np.int64)
        later[: max(0, len(rank) - step)] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + later + 1, return_inverse=True)[1].astype(np.int64)
        length += step
    return rank


def run_digests(
    pages: Sequence[tuple[object, Sequence[str]]], rank: np.ndarray, run: int, wanted: np.ndarray | None = None
) -> dict[int, bytes]:
    """The digests of all runs (or of those with the ``wanted`` ranks) of the pages laid end to end, by their rank."""
    flat = [w for _, text in pages for w in [*text, None]]
    inside = np.zeros(len(flat), bool)
    at = 0
    for _, text in pages:
        inside[at : at + max(0, len(text) - run + 1)] = True
        at += len(text) + 1
    if wanted is not None:
        inside &= np.isin(rank, wanted)
    places = np.flatnonzero(inside)
    known, first = np.unique(rank[places], return_index=True)
    return {int(k): _digest(flat[i : i + run]) for k, i in zip(known, places[first].tolist(), strict=True)}


def _laid(pages: Sequence[tuple[object, Sequence[str]]], run: int) -> tuple[dict[object, int], np.ndarray, np.ndarray]:
    """The pages' numbers; of each word (and end) of the pages laid end to end the page's number and the suffix rank."""
    numbers: dict[object, int] = {}
    words: dict[str, int] = {}
    tokens, owner = [], []
    for k, (name, text) in enumerate(pages):
        numbers.setdefault(name, len(numbers))
        tokens += [words.setdefault(w, len(words)) for w in text] + [-k - 1]  # an end of its own
        owner += [numbers[name]] * (len(text) + 1)
    token, page = np.array(tokens, np.int64), np.array(owner, np.int64)
    return numbers, page, suffix_ranks(token, run)


def repeated_words(
    pages: Sequence[tuple[object, Sequence[str]]], run: int = RUN, elsewhere: frozenset[bytes] = frozenset()
) -> list[np.ndarray]:
    """For each page (identity, words) which words are covered by a run on two distinct pages, or whose digest is known from ``elsewhere``."""
    numbers, page, rank = _laid(pages, run)
    low, high = np.full(len(rank), len(numbers)), np.full(len(rank), -1)
    np.minimum.at(low, rank, page)
    np.maximum.at(high, rank, page)
    repeated = low < high  # by rank; ends are unique, so such a run lies inside pages
    if elsewhere:
        repeated[[k for k, digest in run_digests(pages, rank, run).items() if digest in elsewhere]] = True
    begins = repeated[rank]
    change = np.zeros(len(rank) + 1, np.int64)
    np.add.at(change, np.flatnonzero(begins), 1)
    np.add.at(change, np.minimum(np.flatnonzero(begins) + run, len(rank)), -1)
    covered = np.cumsum(change)[:-1] > 0
    out, at = [], 0
    for _, text in pages:
        out.append(covered[at : at + len(text)])
        at += len(text) + 1
    return out


def unique_text(blocks: Sequence[str], covered: np.ndarray) -> str:
    """The words of the blocks that are not covered, blocks without any left out."""
    lines, at = [], 0
    for block in blocks:
        words = block.split(" ")
        kept = [w for w, c in zip(words, covered[at : at + len(words)], strict=True) if not c]
        at += len(words)
        if kept:
            lines.append(" ".join(kept))
    return "\n".join(lines)


def extract_text(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1)).alias("host")
    rows = pages.select("page_id", "url", host, F.coalesce("html", F.lit("")).alias("html"))

    def compute(texts: list[bytes | None]) -> list[pa.Array]:
        """The text of a page with a container, or else the blocks of the page."""
        found = [parse((t or b"").decode("utf-8", "replace")) for t in texts]
        boxed = [any(b.zone for b in blocks) for blocks in found]
        inside = [contained(blocks) if box else None for blocks, box in zip(found, boxed, strict=True)]
        listed = [None if box else [b.text for b in blocks] for blocks, box in zip(found, boxed, strict=True)]
        return [pa.array(inside, pa.string()), pa.array(listed, pa.list_(pa.string()))]

    # parsed twice, for the runs of the hosts and for the result: that takes less room than to keep the texts
    parsed = with_text_columns(rows, "text string, blocks array<string>", compute, "html").drop("html")
    stated = materialise(_stated(parsed, rows, run), "stated")
    decided = _without_notices(parsed.where("blocks is null").drop("blocks"), stated, run)
    parsed = stated.where("blocks is not null").select("page_id", "url", "host", "blocks")
    if parsed.isEmpty():
        return decided
    extent = parsed.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    placed = parsed.join(extent, "host").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("groups")))
    fields = ["host", "part", "page_id", "url", "blocks"]
    several = placed.where("groups > 1").select(fields)
    pages = placed.select(*fields, F.lit(None).cast("binary").alias("run"))
    if not several.isEmpty():
        none = {c: F.lit(None).cast(parsed.schema[c].dataType) for c in fields[2:]}
        pages = pages.unionByName(_met_elsewhere(several, run).withColumns(none))
    return decided.unionByName(_by_host(pages, run))


def frequent_runs(texts: Sequence[str], run: int = RUN) -> list[bytes]:
    """The digests of the runs that at least half of the texts hold."""
    pages = [(k, text.split()) for k, text in enumerate(texts)]
    _, page, rank = _laid(pages, run)
    held, n = np.unique(np.unique(rank * len(pages) + page) // len(pages), return_counts=True)  # of every rank the number of its pages
    often = held[2 * n >= len(pages)]
    known = run_digests(pages, rank, run, often)
    return [known[k] for k in often.tolist() if k in known]


def _digest(words: Sequence[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()


def _stated(parsed: DataFrame, rows: DataFrame, run: int) -> DataFrame:
    """What the groups of the hosts state: the runs that half of the group's texts in containers hold and, once, the number of these texts.

    Pages without a container are handed on. Equal texts lie in one group and count once.
    """
    large = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups")).where("groups > 1")
    placed = parsed.join(materialise(large, "large-hosts"), "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    boxed = F.col("blocks").isNull()
    # a text takes part for its host, whatever page it is of
    fields = {c: F.when(~boxed, F.col(c)) for c in ("page_id", "url")}
    placed = placed.withColumns(fields).withColumn("part", F.pmod(F.when(boxed, F.xxhash64("text")).otherwise(F.xxhash64("page_id", "url")), F.col("groups")))
    kind = parsed.schema["page_id"].dataType.simpleString()
    columns = f"host string, page_id {kind}, url string, blocks array<string>, run binary, texts bigint"

    def state(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def once(tables: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Hand on each text of a group once and pages without a container at once; equal texts lie side by side."""
            last = None
            for batch in tables:
                types.update((f.name, f.type) for f in batch.schema)
                marks = list(zip(*(batch.column(c).to_pylist() for c in ("host", "part", "text")), strict=True))
                keep = [m[2] is not None and m != (marks[k - 1] if k else last) for k, m in enumerate(marks)]
                last = marks[-1] if marks else last
                listed = batch.filter(batch.column("blocks").is_valid())
                if listed.num_rows:
                    passed.append(listed)
                yield batch.select(["host", "part", "groups", "text"]).filter(pa.array(keep, pa.bool_()))

        def out(hosts: list, runs: list, texts: list) -> pa.RecordBatch:
            none = lambda name: pa.nulls(len(hosts), types[name])
            arrays = [pa.array(hosts, pa.string()), none("page_id"), none("url"), none("blocks"), pa.array(runs, pa.binary()), pa.array(texts, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def hand_on() -> Iterator[pa.RecordBatch]:
            while passed:
                b = passed.pop()
                arrays = [*(b.column(c) for c in names[:4]), pa.nulls(b.num_rows, pa.binary()), pa.nulls(b.num_rows, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from hand_on()
            for group in _groups(table):
                host, texts = group.column("host")[0].as_py(), group.column("text").to_pylist()
                if group.column("groups")[0].as_py() > 1 or len(texts) >= TEXTS:
                    runs = frequent_runs(texts, run)
                    yield out([host] * (len(runs) + 1), [None, *runs], [len(texts), *[None] * len(runs)])

        passed: list[pa.RecordBatch] = []
        yield from sorted_groups(once(batches), ("host", "part"), None, handle)
        yield from hand_on()

    names = [c.split()[0] for c in columns.split(", ")]
    types: dict[str, pa.DataType] = {}
    dealt = placed.select("host", "part", "groups", "page_id", "url", "text", "blocks").repartition("host", "part")
    return dealt.sortWithinPartitions("host", "part", "text").mapInArrow(state, columns)


def _without_notices(boxed: DataFrame, stated: DataFrame, run: int) -> DataFrame:
    """(page_id, url, text) of pages (page_id, url, host, text) with a container, without the notices of their host."""
    texts = stated.groupBy("host").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= TEXTS)
    found = stated.where("run is not null").groupBy("host").agg(F.collect_set("run").alias("runs")).join(texts, "host")
    found = materialise(found, "frequent-runs")
    if found.isEmpty():
        return boxed.select("page_id", "url", "text")

    def hold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, text, runs in zip(*(batch.column(c).to_pylist() for c in ("host", "text", "runs")), strict=True):
                words, known = text.split(), frozenset(runs)
                own = {d for i in range(len(words) - run + 1) if (d := _digest(words[i : i + run])) in known}
                out += [(host, d, _digest([text])) for d in own]
            columns = zip(*out, strict=True) if out else ([], [], [])
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "run", "of"])

    held = boxed.select("host", "text").join(found.select("host", "runs"), "host").mapInArrow(hold, "host string, run binary, of binary")
    counts = held.distinct().groupBy("host", "run").agg(F.count(F.lit(1)).alias("n")).join(found.select("host", "texts"), "host")
    notices = counts.where("2 * n >= texts").groupBy("host").agg(F.collect_list("run").alias("runs"))
    notices = materialise(notices, "notices")

    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [names.index(c) for c in ("text", "runs")]
        for batch in batches:
            texts = [without_runs(t, frozenset(r), run) if r else t for t, r in zip(*(batch.column(k).to_pylist() for k in at), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    names = ["page_id", "url", "text", "runs"]
    kind = boxed.schema["page_id"].dataType.simpleString()
    return boxed.join(notices, "host", "left").select(names).mapInArrow(drop, f"page_id {kind}, url string, text string")


def without_runs(text: str, runs: frozenset[bytes], run: int = RUN) -> str:
    """The text without the blocks that ``runs`` cover, unless it would lose too much."""
    blocks = [b.split(" ") for b in text.split("\n")]
    words = [w for b in blocks for w in b]
    covered = np.zeros(len(words), bool)
    for i in range(len(words) - run + 1):
        if _digest(words[i : i + run]) in runs:
            covered[i : i + run] = True
    kept, at, lost = [], 0, 0
    for block in blocks:
        if covered[at : at + len(block)].all():
            lost += len(block)
        else:
            kept.append(" ".join(block))
        at += len(block)
    return text if lost > LOSS * len(words) else "\n".join(kept)


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("host", "part").sortWithinPartitions("host", "part", *order, "page_id", "url")


def _groups(table: pa.Table) -> Iterator[pa.Table]:
    places = list(zip(table.column("host").to_pylist(), table.column("part").to_pylist(), strict=True))
    cuts = [0, *[k for k in range(1, len(places)) if places[k] != places[k - 1]], len(places)]
    for first, end in zip(cuts, cuts[1:], strict=False):
        yield table.slice(first, end - first)


def _pages(table: pa.Table) -> list[tuple[object, list[str]]]:
    ids, urls, blocks = (table.column(c).to_pylist() for c in ("page_id", "url", "blocks"))
    words = [[w for b in page for w in b.split(" ")] for page in blocks]
    return list(zip(zip(ids, urls, strict=True), words, strict=True))


def _met_elsewhere(pages: DataFrame, run: int) -> DataFrame:
    """(host, part, run): of each group the digests of its runs that another group of the host holds too.

    Rows of an identity lie in one group, so groups that share a run hold it on distinct pages. A run makes one row per group.
    """

    def state(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for group in _groups(table):
                laid = _pages(group)
                digests = list(run_digests(laid, _laid(laid, run)[2], run).values())
                place = [pa.array([group.column(c)[0].as_py()] * len(digests), group.schema.field(c).type) for c in ("host", "part")]
                yield pa.RecordBatch.from_arrays([*place, pa.array(digests, pa.binary())], names=["host", "part", "run"])

        yield from sorted_groups(batches, ("host", "part"), None, handle)

    stated = materialise(_dealt(pages).mapInArrow(state, "host string, part bigint, run binary"), "runs")
    shared = stated.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("host", "run")
    return stated.join(shared, ["host", "run"], "left_semi").select("host", "part", "run")


def _by_host(rows: DataFrame, run: int) -> DataFrame:
    kind = rows.schema["page_id"].dataType.simpleString()

    def unique(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for group in _groups(table):
                is_page = group.column("run").is_null()
                pages, elsewhere = group.filter(is_page), group.filter(pa.compute.invert(is_page)).column("run").to_pylist()
                covered = repeated_words(_pages(pages), run, frozenset(elsewhere))
                texts = [unique_text(b, c) for b, c in zip(pages.column("blocks").to_pylist(), covered, strict=True)]
                out = [*(pages.column(c).combine_chunks() for c in ("page_id", "url")), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["page_id", "url", "text"])

        yield from sorted_groups(batches, ("host", "part"), None, handle)

    return _dealt(rows, "run").mapInArrow(unique, f"page_id {kind}, url string, text string")
