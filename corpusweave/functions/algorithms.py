"""Sequential algorithms that no built-in expresses, as Arrow functions over one row or one bounded group.

Null texts count as empty everywhere, and give no row where a function gives a row for each found thing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


PIECE, HELD = 256, 1 << 20


def small_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of at most PIECE rows, halved while they hold more than HELD bytes."""
    for b in batches:
        todo = [b.slice(low, PIECE) for low in range(0, b.num_rows, PIECE)][::-1]
        while todo:
            piece = todo.pop()
            if piece.num_rows > 1 and piece.nbytes > HELD:
                half = piece.num_rows // 2
                todo += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece


def flat_map(df: DataFrame, columns: list[str], schema: str, function: Callable[..., list[tuple]]) -> DataFrame:
    """The rows that ``function`` gives for the values of ``columns``, piece by piece of a batch, so that Python holds the values of at most
    ``PIECE`` rows and some ``HELD`` bytes (a larger row is alone) beside Arrow's batch, however large the batch is."""
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_pieces(batches):
            rows = [row for values in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in function(*values)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[t]) for i, t in enumerate(types)], list(names))

    return df.select(*columns).mapInArrow(part, schema)


def packed(sizes: list[int], max_chars: int, max_items: int, overhead: int) -> list[tuple[int, int]]:
    """Order-preserving bins as (items, characters) with hard caps, near equal: the number of bins that the caps ask
    for is found first, then each bin closes at the even share.  An item over the cap is a bin of its own."""
    total = sum(s + overhead for s in sizes)
    share = total / max(1, -(-total // max_chars)) if sizes else 0
    bins, n, chars = [], 0, 0
    for s in sizes:
        cost = s + overhead
        if n and (chars + cost > max_chars or n >= max_items or chars + cost / 2 > share):
            bins.append((n, chars))
            n = chars = 0
        n, chars = n + 1, chars + cost
    return [*bins, (n, chars)] if n else bins


def pack_batches(docs: DataFrame, max_chars: int = 600, max_items: int = 12, overhead: int = 8) -> DataFrame:
    def rows(doc_id, text):
        return [(doc_id, i, n, c) for i, (n, c) in enumerate(packed([len(x) for x in (text or "").split("\n") if x], max_chars, max_items, overhead))]

    return flat_map(docs, ["doc_id", "text"], "doc_id long, batch long, n_items long, n_chars long", rows)


def sentences(text: str | None) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]


def beads(a: list[int], b: list[int], side: int = 4) -> list[tuple[int, int]]:
    """Greedy monotone m:n beads: of the group sizes up to ``side`` the pair whose lengths are nearest to the texts' ratio."""
    out, i, j = [], 0, 0
    ratio = sum(b) / sum(a) if sum(a) else 1.0
    while i < len(a) and j < len(b):
        best = min(((abs(sum(a[i : i + m]) * ratio - sum(b[j : j + n])) / (sum(a[i : i + m]) + sum(b[j : j + n]) + 1), m + n, m, n) for m in range(1, side + 1) for n in range(1, side + 1) if i + m <= len(a) and j + n <= len(b)))
        out.append((best[2], best[3]))
        i, j = i + best[2], j + best[3]
    if i < len(a) or j < len(b):
        out.append((len(a) - i, len(b) - j))
    return out


def align_sentences(pairs: DataFrame) -> DataFrame:
    def rows(conv, turn, src, tgt):
        a, b = sentences(src), sentences(tgt)
        found = beads([len(x) for x in a], [len(x) for x in b])
        return [(conv, turn, len(a), len(b), len(found), ",".join(f"{m}:{n}" for m, n in found))]

    return flat_map(pairs, ["conv_id", "turn", "src", "tgt"], "conv_id long, turn long, n_src long, n_tgt long, n_beads long, beads string", rows)


_MARKUP = re.compile(r"(?P<blank>\n[ \t]*\n+|\n)|(?P<token>\[\[[A-Z]+_\d+\]\])|(?P<command>\\[A-Za-z]+\*?(?:\{[^{}]*\})?)|(?P<math>\$[^$\n]*\$)|(?P<comment>(?<!\\)%[^\n]*)")


def pieces(text: str) -> list[tuple[int, int, str]]:
    """A gap-free tiling of the text by prose and marks of a small markup: line ends, tokens, commands, math, comments."""
    out, at = [], 0
    for m in _MARKUP.finditer(text):
        if m.start() > at:
            out.append((at, m.start(), "prose"))
        if m.end() > m.start():
            out.append((m.start(), m.end(), m.lastgroup or "prose"))
        at = max(at, m.end())
    if at < len(text):
        out.append((at, len(text), "prose"))
    return out


def chunk_scan(docs: DataFrame) -> DataFrame:
    def rows(doc_id, text):
        found = pieces(text or "")
        tiled = all(x[1] == y[0] for x, y in zip(found, found[1:], strict=False)) and (not found or (found[0][0] == 0 and found[-1][1] == len(text)))
        kinds = Counter(k for _, _, k in found)
        return [(doc_id, len(found), kinds["prose"], kinds["math"] + kinds["command"] + kinds["token"], tiled)]

    return flat_map(docs, ["doc_id", "text"], "doc_id long, n_pieces long, n_chunks long, n_placeholders long, tiled boolean", rows)


def residual_spans(docs: DataFrame, least: int = 4) -> DataFrame:
    """Runs of ``least`` or more decorated words outside masked pieces."""
    run = re.compile(rf"(?:\w+[*#$%&!]{{2,}}\s*){{{least},}}")

    def rows(doc_id, text):
        return [(doc_id, a + m.start(), a + m.end()) for a, b, kind in pieces(text or "") if kind == "prose" for m in run.finditer((text or "")[a:b])]

    return flat_map(docs, ["doc_id", "text"], "doc_id long, start long, end long", rows)


def residual_runs(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Runs of ``least`` or more words that the target has verbatim from the source."""

    def rows(conv, turn, src, tgt):
        a, b = (re.findall(r"\w+", (x or "").lower()) for x in (src, tgt))
        known = {tuple(a[i : i + least]) for i in range(len(a) - least + 1)}
        runs, i = [], 0
        while i + least <= len(b):
            j = i
            while tuple(b[j : j + least]) in known and j + least <= len(b):
                j += 1
            if j > i:
                runs.append(j - i + least - 1)
                i = j + least - 1
            else:
                i += 1
        return [(conv, turn, len(runs), max(runs, default=0))]

    return flat_map(pairs, ["conv_id", "turn", "src", "tgt"], "conv_id long, turn long, n_runs long, longest long", rows)


def sniff(raw: bytes) -> str:
    """Byte order mark, then NUL pattern, then strict UTF-8, then the candidate with the fewest odd characters."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return name
    if raw and raw[1::2].count(0) * 3 > len(raw):
        return "utf-16-le"
    if raw and raw[::2].count(0) * 3 > len(raw):
        return "utf-16-be"
    try:
        raw.decode("utf-8")
        return "ascii" if raw.isascii() else "utf-8"
    except UnicodeDecodeError:
        pass
    scores = []
    for rank, name in enumerate(("gb18030", "shift_jis", "cp1252", "latin-1")):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        odd = sum(not (c.isalnum() or c.isspace() or c.isprintable()) or "\x80" <= c <= "\x9f" for c in text)
        wide = sum("一" <= c <= "鿿" or "぀" <= c <= "ヿ" for c in text)
        scores.append((odd * 4 + (len(text) - wide if name in ("gb18030", "shift_jis") else len(text) // 2), rank, name))
    return min(scores)[2]


def sniff_encodings(docs: DataFrame) -> DataFrame:
    return flat_map(docs, ["doc_id", "text"], "doc_id long, encoding string", lambda doc_id, text: [(doc_id, sniff((text or "").encode("utf-8", "surrogatepass")))])


_MUTATIONS: tuple[tuple[str, Callable[[str], str]], ...] = (
    ("drop_last_word", lambda t: t.rpartition(" ")[0]),
    ("drop_half", lambda t: t[: len(t) // 2]),
    ("double", lambda t: f"{t} {t}"),
    ("upper", str.upper),
    ("drop_stops", lambda t: t.replace(".", "")),
    ("drop_commas", lambda t: t.replace(",", "")),
    ("join_lines", lambda t: t.replace("\n", " ")),
    ("extra_token", lambda t: f"{t} [[X_1]]"),
    ("open_brace", lambda t: f"{t} {{"),
    ("empty", lambda t: ""),
)


def detected(src: str, tgt: str) -> list[str]:
    """Names of the pair checks that fail."""
    out = [name for name, p in (("stops", r"\."), ("commas", ","), ("tokens", r"\[\[[A-Z]+_\d+\]\]"), ("braces", r"[{}]"), ("lines", r"\n"), ("upper", r"[A-Z]")) if len(re.findall(p, src)) != len(re.findall(p, tgt))]
    if not tgt.strip():
        out.append("empty")
    return out + (["length"] if not 0.9 * len(src) - 12 <= len(tgt) <= 1.1 * len(src) + 12 else [])


def corruptions(docs: DataFrame) -> DataFrame:
    """For each document and mutation the number of checks that notice it; the clean control must give none."""

    def rows(doc_id, text):
        t = text or ""
        return [(doc_id, name, len(detected(t, f(t)))) for name, f in (("clean", lambda x: x), *_MUTATIONS)]

    return flat_map(docs, ["doc_id", "text"], "doc_id long, mutation string, n_checks long", rows)


def heaviest_chain(values: list[float], weights: list[int]) -> int:
    """Weight of the heaviest subsequence with non-decreasing values, in n log n."""
    order = sorted(set(values))
    tree = [0] * (len(order) + 1)
    for v, w in zip(values, weights, strict=True):
        i = bisect_right(order, v)
        best, k = 0, i
        while k:
            best, k = max(best, tree[k]), k & (k - 1)
        best, k = best + w, i
        while k < len(tree):
            tree[k], k = max(tree[k], best), k + (k & -k)
    return max(tree)


def monotone_chain(events: DataFrame) -> DataFrame:
    def group(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("event_id", "value", "user_id")), strict=True))
        best = heaviest_chain([r[1] for r in rows], [1 + r[0] % 3 for r in rows])
        return pa.table({"user_id": pa.array([rows[0][2]], pa.int64()), "n": pa.array([len(rows)], pa.int64()), "weight": pa.array([best], pa.int64())})

    return events.where("value is not null").select("event_id", "value", "user_id").groupBy("user_id").applyInArrow(group, "user_id long, n long, weight long")


def within_two(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 2:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= 2


def matching(adjacent: list[list[int]]) -> int:
    """Size of a maximum bipartite matching, by augmenting paths on a stack of their own."""
    owner: dict[int, int] = {}
    for start in range(len(adjacent)):
        seen: set[int] = set()
        path, via, left = [start], [-1], [iter(adjacent[start])]
        while path:
            j = next((j for j in left[-1] if j not in seen), None)
            if j is None:
                path.pop(), via.pop(), left.pop()
                continue
            seen.add(j)
            if j not in owner:
                for i, before in zip(reversed(path), reversed(via), strict=True):
                    owner[j], j = i, before
                break
            path.append(owner[j])
            via.append(j)
            left.append(iter(adjacent[owner[j]]))
    return len(owner)


def _thirds(n: int) -> tuple[tuple[int, int], ...]:
    a, b = n // 3, 2 * n // 3
    return (0, a), (a, b), (b, n)


def near_words(words: list[str], others: list[str]) -> list[list[int]]:
    """For each word the places of the others within two edits.

    Two edits leave one of three parts of the other word as it is, moved by two letters at most, so only words
    that share such a part are compared."""
    parts: dict[tuple[int, int, str], list[int]] = {}
    for j, y in enumerate(others):
        for k, (a, b) in enumerate(_thirds(len(y))):
            parts.setdefault((len(y), k, y[a:b]), []).append(j)
    lengths = {len(y) for y in others}
    out = []
    for x in words:
        near: set[int] = set()
        for n in lengths.intersection(range(len(x) - 2, len(x) + 3)):
            for k, (a, b) in enumerate(_thirds(n)):
                for piece in {x[a + d : b + d] for d in range(max(-2, -a), 3)}:
                    near.update(parts.get((n, k, piece), ()))
        out.append([j for j in sorted(near) if within_two(x, others[j])])
    return out


def typo_matching(pairs: DataFrame) -> DataFrame:
    """Words of the source that the target lacks, matched with new words of the target within two edits."""

    def rows(conv, turn, src, tgt):
        a, b = ({w for w in re.findall(r"[a-z]{4,}", (x or "").lower())} for x in (src, tgt))
        gone, new = sorted(a - b), sorted(b - a)
        return [(conv, turn, len(gone), len(new), matching(near_words(gone, new)))]

    return flat_map(pairs, ["conv_id", "turn", "src", "tgt"], "conv_id long, turn long, n_missing long, n_new long, n_matched long", rows)


class _Blocks(HTMLParser):
    KINDS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th figcaption title".split())
    SILENT = frozenset("script style template noscript".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.kind, self.text, self.silent = "", [], 0

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.found.append((self.kind or "text", text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        self.silent += tag in self.SILENT
        if tag in self.KINDS or tag in ("div", "article", "nav", "ul", "body", "footer", "br"):
            self.flush()
            self.kind = tag if tag in self.KINDS else self.kind if tag == "br" else ""

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in self.SILENT))
        if tag in self.KINDS:
            self.flush()
            self.kind = ""

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def html_blocks(pages: DataFrame) -> DataFrame:
    """Ordered block rows of each page: (page_id, pos, kind, text)."""

    def rows(page_id, html):
        parser = _Blocks()
        parser.feed(html or "")
        parser.close()
        parser.flush()
        return [(page_id, i, kind, text) for i, (kind, text) in enumerate(parser.found)]

    return flat_map(pages, ["page_id", "html"], "page_id long, pos long, kind string, text string", rows)


def greedy_cover(events: DataFrame, cap: int = 12, floor: int = 2) -> DataFrame:
    """At most ``cap`` users whose tags cover as many tags as they can: ``floor`` users with the most tags, then
    the user with most uncovered tags until all are covered, then the users with the rarest tags (the sum over a
    user's tags of one over its count).  Ties go to the smaller user.

    Each pick is a top-1 aggregation over all users; only the tags, which are few, come to the driver."""
    tag = F.concat("event_type", F.lit("-"), (F.col("event_id") % 13).cast("string"))
    pairs = events.where("value > 80").select("user_id", tag.alias("tag")).distinct().persist()
    left, picked = {r["tag"] for r in pairs.select("tag").distinct().collect()}, []
    free = lambda: pairs.where(~F.col("user_id").isin([p[1] for p in picked])) if picked else pairs

    def take(best: list, step: str) -> None:
        for r in best:
            own = {x["tag"] for x in pairs.where(F.col("user_id") == r["user_id"]).select("tag").collect()}
            picked.append((len(picked) + 1, r["user_id"], step, len(own & left)))
            left.difference_update(own)

    order = [F.desc("n"), "user_id"]
    take(free().groupBy("user_id").agg(F.count("*").alias("n")).orderBy(*order).limit(min(floor, cap)).collect(), "floor")
    while left and len(picked) < cap:
        best = free().where(F.col("tag").isin(sorted(left))).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(*order).limit(1).collect()
        if not best:
            break
        take(best, "cover")
    if len(picked) < cap:
        rare = pairs.groupBy("tag").agg((1 / F.count("*")).alias("r"))
        score = free().join(rare, "tag").groupBy("user_id").agg(F.round(F.sum("r"), 9).alias("n"))
        take(score.orderBy(*order).limit(cap - len(picked)).collect(), "rarity")
    pairs.unpersist()
    return events.sparkSession.createDataFrame(picked, "pos long, user_id long, step string, gain long")


def expand_fixpoint(docs: DataFrame) -> DataFrame:
    """Expands doubled decoration marks until nothing changes, which it must, as each round shortens the text: (doc_id, rounds, n_chars)."""
    rule = re.compile(r"([*#$%&!])\1")

    def rows(doc_id, text):
        t, n = text or "", 0
        while (new := rule.sub(r"\1", t)) != t:
            t, n = new, n + 1
        return [(doc_id, n, len(t))]

    return flat_map(docs, ["doc_id", "text"], "doc_id long, rounds long, n_chars long", rows)


def bib_entries(texts: DataFrame) -> DataFrame:
    """(doc_id, kind, key, n_fields) of brace-balanced entries; the first of a key wins, string macros stand apart."""

    def rows(doc_id, text):
        out, seen = [], set()
        for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s{}=]*)", text or ""):
            depth, at = 1, m.end()
            while at < len(text) and depth:
                depth += {"{": 1, "}": -1}.get(text[at], 0)
                at += 1
            kind, key = m[1].lower(), m[2]
            if depth == 0 and (kind == "string" or key not in seen):
                seen.add(key)
                out.append((doc_id, kind, key, len(re.findall(r"\w+\s*=", text[m.end() : at]))))
        return out

    return flat_map(texts, ["doc_id", "text"], "doc_id long, kind string, key string, n_fields long", rows)
