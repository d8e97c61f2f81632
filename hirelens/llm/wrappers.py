"""Main text of pages: wrappers, union-free regular expressions over the tokens of a host's pages, inferred by alignment."""

from __future__ import annotations

import html
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|title|noscript|iframe|svg|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
HINT = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements that run with the text around them. Only a link is told apart, for the share of linked text.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base col embed hr img input link meta param source track".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: An open list or table keeps what stands outside it from being closed by an item inside.
FENCE = set("ul ol dl table article section main div body nav aside footer header form".split())
NEVER = set("head nav footer aside form button fieldset dialog menu object audio video canvas map".split())
MAIN = {"article", "main"}
MAIN_HINT = re.compile(r"(?:^|[\s_-])(?:article-?body|post-?(?:content|body)|entry-?content|main-?content|story-?body|main|article)(?:$|[\s_-])", re.I)
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modal|overlay|newsletter|subscri\w*|sign-?up|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|side-?bars?|aside|widgets?|related|recommend\w*|share|sharing|social|comments?|respond|replies|discussion|disqus|"
    r"footer|masthead|site-header|page-header|login|search|toolbar|pagination|pager|complementary|contentinfo|skip)(?:$|[\s_-])", re.I)
SLOT = "#"


def parse(page: str) -> list:
    """The page as a tree: [label, children]; a child is a tree or a slot [SLOT, pieces, length, linked length, checksum of the page's texts]."""
    root: list = ["page", []]
    stack, links, quiet = [root], 0, None
    slot, slots = None, []
    for m in TOKEN.finditer(page):
        raw, close, tag, attributes = m.group(1), m.group(2), m.group(3), m.group(4)
        text = m.group()
        if raw or text.startswith(("<!", "<?")):
            continue
        if tag is None:
            if slot is None:
                if text.isspace():
                    continue
                slot = [SLOT, [], 0, 0, 0]
                slots.append(slot)
                stack[-1][1].append(slot)
            slot[1].append(text)
            slot[2] += len(text)
            slot[3] += len(text) if links else 0
            continue
        tag = tag.lower()
        if tag in INLINE:
            hint = " ".join(x.strip("\"'") for x in HINT.findall(attributes)) if not close and "=" in attributes else ""
            if not (hint and NOISE.search(hint)) and not (close and any(s[0].split(" ")[0] == tag for s in stack[-2:])):
                if tag == "a":
                    links = max(0, links + (-1 if close else 1))
                elif tag == "br" and slot is not None:
                    slot[1].append(" ")
                continue
        elif tag in VOID:
            slot = None
            continue
        slot = None
        if close:
            for i in range(len(stack) - 1, 0, -1):
                name = stack[i][0].split(" ")[0]
                if name == tag:
                    del stack[i:]
                    links = 0
                    break
                if name in FENCE and tag not in FENCE:
                    break
            continue
        ends = CLOSES.get(tag, ())
        if stack[-1][0].split(" ")[0] == "p" and tag not in INLINE:
            stack.pop()
        while ends and len(stack) > 1 and (name := stack[-1][0].split(" ")[0]) not in FENCE:
            if name in ends or any(s[0].split(" ")[0] in ends for s in stack[-3:] if s[0].split(" ")[0] not in FENCE):
                stack.pop()
            else:
                break
        hint = " ".join(x.strip("\"'").lower() for x in HINT.findall(attributes)) if "=" in attributes else ""
        node: list = [tag + (" " + re.sub(r"\d+", "0", hint) if hint else ""), []]
        stack[-1][1].append(node)
        stack.append(node)
    # Pages of the same texts are copies of one page; 0 stands for several pages.
    own = zlib.crc32("\0".join(_text(x) for x in slots).encode("utf-8", "replace")) or 1
    for slot in slots:
        slot[4] = own
    return root


def _text(slot: list) -> str:
    return "".join(slot[1])


def _sum(slot: list) -> int:
    return zlib.crc32(_text(slot).encode("utf-8", "replace"))


# A wrapper is [key, mark, body]: mark is "1", "?", "+" or "*"; the body of a slot is None if its text
# differs, or [checksum of the text, page]: the one page that has it, 0 if different pages have it;
# the body of an element or a group is a list.


def fold(nodes: list, memo: dict | None = None) -> tuple[list, list]:
    """(items, instances): the nodes as a union-free expression, and for every item the nodes that each repetition holds.

    Lists of children are folded from the innermost outwards, each once; `memo` keeps them.
    """
    memo = {} if memo is None else memo
    if id(nodes) not in memo:
        lists = [nodes]
        for part in lists:
            lists += [node[1] for node in part if node[0] != SLOT and id(node[1]) not in memo]
        for part in reversed(lists):
            memo[id(part)] = _folded(part, memo)
    return memo[id(nodes)]


def _folded(nodes: list, memo: dict) -> tuple[list, list]:
    items, held = [], []
    for node in nodes:
        items.append([SLOT, "1", [_sum(node), node[4]]] if node[0] == SLOT else [node[0], "1", memo[id(node[1])][0]])
        held.append([[node]])
    size = 1
    while size <= min(6, len(items) // 2):
        i, again = 0, False
        while i + 2 * size <= len(items):
            if [x[0] for x in items[i:i + size]] == [x[0] for x in items[i + size:i + 2 * size]]:
                end = i + size
                while end + size <= len(items) and [x[0] for x in items[end:end + size]] == [x[0] for x in items[i:i + size]]:
                    end += size
                if size == 1:
                    one = items[i]
                    for other in items[i + 1:end]:
                        one = merge(one, other)
                    items[i:end], held[i:end] = [[one[0], "+" if "1" in one[1] or "+" in one[1] else "*", one[2]]], [[r for h in held[i:end] for r in h]]
                else:
                    body = items[i:i + size]
                    for at in range(i + size, end, size):
                        body = [merge(a, b) for a, b in zip(body, items[at:at + size])]
                    runs = [[n for h in held[at:at + size] for r in h for n in r] for at in range(i, end, size)]
                    items[i:end], held[i:end] = [["(" + "|".join(x[0] for x in body) + ")", "+", body]], [runs]
                again = True
            i += 1
        size = 1 if again and size > 1 else size + 1
    return items, held


def _marks(a: str, b: str) -> str:
    many, may = "+*", "?*"
    return {(False, False): "1", (True, False): "+", (False, True): "?", (True, True): "*"}[(a in many or b in many, a in may or b in may)]


def _finish(todo: list) -> None:
    """Fill the holes (a, b, hole) with the expressions found for both; children leave holes of their own."""
    while todo:
        a, b, hole = todo.pop()
        if a[0] == SLOT:
            same = a[2] and b[2] and a[2][0] == b[2][0]
            hole[:] = [SLOT, _marks(a[1], b[1]), [a[2][0], a[2][1] if a[2][1] == b[2][1] else 0] if same else None]
        else:
            hole[:] = [a[0], _marks(a[1], b[1]), _aligned(a[2], b[2], todo)]


def merge(a: list, b: list) -> list:
    """The smallest expression found for both: slots that differ become variable, unmatched items optional, runs repeated."""
    whole: list = []
    _finish([(a, b, whole)])
    return whole


def _grouped(items: list, other: list) -> list:
    """Items with a single run of a group of the other side written as that group."""
    for key, body in ((x[0], x[2]) for x in other if x[0].startswith("(")):
        names, i = [x[0] for x in body], 0
        while names and i + len(names) <= len(items):
            if [x[0] for x in items[i:i + len(names)]] == names:
                items = [*items[:i], [key, "1", items[i:i + len(names)]], *items[i + len(names):]]
            i += 1
    return items


def pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of keys; -1 stands for no partner."""
    n, m = len(a), len(b)
    if n == m and all(x[0] == y[0] for x, y in zip(a, b)):
        return [(i, i) for i in range(n)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((i, -1))
            i += 1
        else:
            out.append((-1, j))
            j += 1
    return out


def _aligned(a: list, b: list, todo: list) -> list:
    a, b = _grouped(a, b), _grouped(b, a)
    out: list = []
    for i, j in pairs(a, b):
        if i >= 0 and j >= 0:
            out.append([])
            todo.append((a[i], b[j], out[-1]))
        else:
            x = a[i] if i >= 0 else b[j]
            out.append([x[0], _marks(x[1], "?"), x[2]])
    return out


def align(a: list, b: list) -> list:
    """Two item lists as one: what only one side has becomes optional."""
    todo: list = []
    out = _aligned(a, b, todo)
    _finish(todo)
    return out


def _has_main(nodes: list) -> bool:
    """Whether a reader of the page comes to a marked article: not through what is never read."""
    todo = [nodes]
    while todo:
        for x in todo.pop():
            if x[0] == SLOT:
                continue
            if _main(x[0]):
                return True
            if not _skipped(x[0]):
                todo.append(x[1])
    return False


def _skipped(key: str) -> bool:
    """Outside an article a page's header is left out as well."""
    return _never(key) or key.split(" ")[0] == "header"


def _main(key: str) -> bool:
    tag, _, hint = key.partition(" ")
    return not key.startswith("(") and not _never(key) and (tag in MAIN or bool(hint) and tag not in ("html", "body") and bool(MAIN_HINT.search(hint)))


def _never(key: str) -> bool:
    tag, _, hint = key.partition(" ")
    return not key.startswith("(") and (tag in NEVER or tag not in ("html", "body") and bool(hint) and bool(NOISE.search(hint)))


def _slots(items: list):
    todo = [items]
    while todo:
        for x in todo.pop():
            if x[0] == SLOT:
                yield x[2]
            else:
                todo.append(x[2])


def dumps(items: list) -> str:
    """A wrapper as one flat list: key, mark, and the body of a slot or the number of items of an element."""
    flat: list = [len(items)]
    todo = list(reversed(items))
    while todo:
        key, mark, body = todo.pop()
        flat += [key, mark, body if key == SLOT else len(body)]
        if key != SLOT:
            todo += reversed(body)
    return json.dumps(flat)


def loads(text: str) -> list:
    flat = json.loads(text)
    root: list = []
    stack, at = [(root, flat[0])], 1
    while stack:
        body, size = stack[-1]
        if len(body) == size:
            stack.pop()
            continue
        key, mark, held = flat[at:at + 3]
        at += 3
        body.append([key, mark, held if key == SLOT else []])
        if key != SLOT:
            stack.append((body[-1][2], held))
    return root


def varies(items: list) -> bool:
    """Whether slots differ between pages, by their texts or by the pages that have them: a host with one page, or copies of one, has no constant text to tell apart."""
    found = {x and x[1] for x in _slots(items)}
    return None in found or len(found - {0}) > 1


def read(page: str, wrapper: list | None, single: bool) -> str:
    """The text of the page's slots that the wrapper holds for main text, in page order."""
    root, memo = parse(page), {}
    whole = wrapper or fold(root[1], memo)[0]
    marked = _has_main(root[1])
    blocks: list[str] = []

    def keep(node: list, slot: list, inside: bool) -> None:
        # On a page without a marked article: text that is not mostly links, nor the same on different pages of the host.
        if inside if marked else (single or slot[2] != [_sum(node), 0]) and node[3] * 2 <= node[2]:
            text = " ".join(html.unescape(_text(node)).split())
            if text:
                blocks.append(text)

    def steps(nodes: list, items: list, inside: bool):
        """What stands in a list of nodes, in page order: (nodes, items, inside) to go into, or (slot, item, inside)."""
        folded, held = fold(nodes, memo)
        # Runs that are a group on the wrapper's side are looked at item by item, as they are written here.
        flat = [y for x in items for y in (x[2] if x[0].startswith("(") else [x])] if not any(f[0].startswith("(") for f in folded) else items
        partner = {i: j for i, j in pairs(folded, flat) if i >= 0}
        for i, (item, runs) in enumerate(zip(folded, held)):
            mine = flat[partner[i]] if partner.get(i, -1) >= 0 else item
            for run in runs:
                if item[0].startswith("("):
                    groups.append(run)
                    yield run, mine[2], inside
                    continue
                for node in run:
                    if node[0] == SLOT:
                        yield node, mine, inside
                    elif not (_never(node[0]) if inside or _main(node[0]) else _skipped(node[0])):
                        yield node[1], mine[2], inside or _main(node[0])

    # Lists made for groups are kept, as the memo knows lists by their place in memory.
    groups: list = []
    todo = [(root[1], whole, False)]
    while todo:
        nodes, items, inside = todo.pop()
        if nodes and nodes[0] == SLOT:
            keep(nodes, items, inside)
        else:
            todo += reversed(list(steps(nodes, items, inside)))
    return " ".join(blocks)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page.

    Every page becomes a union-free expression of its own: equal neighbours, and runs of up
    to six, are repeated groups. Each task aligns the expressions of a host one after the
    other; the distinct results of all tasks are aligned again, so a host with a third of all
    pages costs a wrapper for each task, not a group of pages. Pages are then read against the
    wrapper of their host: menus, notices, forms and comments are left out by the element
    that holds their slot, and on a page where no element is marked as the article, whatever
    other pages of the host have, slots of links are left
    out too, and slots whose text two or more different pages of the host have and none differs in.

    Null and empty html: empty text. Pages without a host form one host. Rows are returned
    one for one, null ids and repeated rows too; other columns are left out. An empty table
    gives an empty result. Elements may be nested to any depth.
    """
    spark = pages.sparkSession
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))

    def infer(batches):
        found: dict[str, list] = {}
        for batch in batches:
            for name, page in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                own = fold(parse(page or "")[1])[0]
                found[name] = align(found[name], own) if name in found else own
                if len(found) > 20_000:
                    yield _table(found)
                    found = {}
        yield _table(found)

    def union(group: pa.Table) -> pa.Table:
        whole = None
        for text in sorted(group.column("wrapper").to_pylist()):
            whole = loads(text) if whole is None else align(whole, loads(text))
        return pa.Table.from_arrays([group.column("host").slice(0, 1), pa.chunked_array([[dumps(whole)]])], ["host", "wrapper"])

    parts = src.select("html", "host").mapInArrow(infer, "host string, wrapper string").distinct()
    # Two levels: a host seen by very many tasks is first united in 64 parts.
    some = parts.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(64))).groupBy("host", "part").applyInArrow(union, "host string, wrapper string")
    wrappers = stored(some.groupBy("host").applyInArrow(union, "host string, wrapper string"))

    def extract(batches):
        known: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if wrapper not in known:
                    if len(known) > 2000:
                        known.clear()
                    shape = loads(wrapper) if wrapper else []
                    known[wrapper] = (shape, not varies(shape))
                texts.append(read(page or "", *known[wrapper]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    out = src.join(wrappers, "host", "left").select("id", "url", "html", "wrapper").mapInArrow(extract, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def _table(found: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"host": pa.array(list(found), pa.string()), "wrapper": pa.array([dumps(w) for w in found.values()], pa.string())})
