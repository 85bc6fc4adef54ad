import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusweave.functions import algorithms as al


@given(st.lists(st.integers(0, 700), max_size=40))
def test_bins_hold_every_item_in_order_within_the_caps(sizes):
    bins = al.packed(sizes, 600, 12, 8)
    assert sum(n for n, _ in bins) == len(sizes)
    assert all(n <= 12 and (c <= 600 or n == 1) for n, c in bins)


@given(st.text(alphabet="ab$\\{}%\n [X_1]", max_size=80))
def test_pieces_tile_the_text(text):
    found = al.pieces(text)
    assert "".join(text[a:b] for a, b, _ in found) == text


@given(st.lists(st.integers(1, 200), max_size=8), st.lists(st.integers(1, 200), max_size=8))
def test_beads_use_every_sentence_once(a, b):
    found = al.beads(a, b)
    assert (sum(m for m, _ in found), sum(n for _, n in found)) == (len(a), len(b))


@settings(max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 4)), max_size=9))
def test_heaviest_chain_is_the_best_of_all(rows):
    values, weights = [r[0] for r in rows], [r[1] for r in rows]
    best = 0
    for mask in range(1 << len(rows)):
        at = [i for i in range(len(rows)) if mask >> i & 1]
        if all(values[x] <= values[y] for x, y in zip(at, at[1:], strict=False)):
            best = max(best, sum(weights[i] for i in at))
    assert al.heaviest_chain([float(v) for v in values], weights) == best


def test_matching_is_maximum_not_greedy():
    assert al.matching([[0], [0, 1], [1, 2]]) == 3
    assert al.matching([[0], [0]]) == 1
    assert al.matching([]) == 0


def test_edit_distance_bound():
    assert al.within_two("kitten", "sitten") and al.within_two("ab", "abcd") and not al.within_two("abc", "xyz")


def test_encodings():
    assert al.sniff(b"abc") == "ascii"
    assert al.sniff("é".encode()) == "utf-8"
    assert al.sniff("文字".encode("gb18030")) == "gb18030"
    assert al.sniff("ab".encode("utf-16-le")) == "utf-16-le"
    assert al.sniff(b"\xef\xbb\xbfx") == "utf-8-sig"


def test_clean_controls_are_not_detected():
    assert al.detected("One, two. Three", "One, two. Three") == []
    assert "empty" in al.detected("One", "")


@given(st.lists(st.text("ab", max_size=7), max_size=12), st.lists(st.text("ab", max_size=7), max_size=12))
def test_near_words_are_all_within_two(a, b):
    assert al.near_words(a, b) == [[j for j, y in enumerate(b) if al.within_two(x, y)] for x in a]


@settings(max_examples=60)
@given(st.lists(st.lists(st.integers(0, 5), max_size=4, unique=True), max_size=6))
def test_matching_is_the_best_of_all(adjacent):
    def best(i, used):
        return 0 if i == len(adjacent) else max([best(i + 1, used)] + [1 + best(i + 1, used | {j}) for j in adjacent[i] if j not in used])

    assert al.matching(adjacent) == best(0, frozenset())


def test_matching_follows_paths_of_any_length():
    n = 3000
    assert al.matching([*([i, i + 1] for i in range(n)), [0]]) == n + 1


def test_typos_of_all_words_are_matched(spark):
    word = lambda i: "".join(chr(97 + int(c)) * 4 for c in f"{i:03}")
    src, tgt = " ".join(map(word, range(150))), " ".join(word(i) + "xy" for i in range(150))
    got = al.typo_matching(spark.createDataFrame([(1, 0, src, tgt)], "conv_id long, turn long, src string, tgt string")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 150, 150, 150)]


def test_cover_takes_floors_then_gains_then_rare_tags(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tags = {}
    for r in events.where("value > 80").select("user_id", "event_type", "event_id").collect():
        tags.setdefault(r["user_id"], set()).add(f"{r['event_type']}-{r['event_id'] % 13}")
    n = {}
    for own in tags.values():
        for t in own:
            n[t] = n.get(t, 0) + 1
    left, want, free = set(n), [], dict(tags)
    for step in ["floor"] * 2 + ["cover"] * 10:
        if not left:
            break
        gain = (lambda u: len(free[u])) if step == "floor" else (lambda u: len(free[u] & left))
        best = min(free, key=lambda u: (-gain(u), u))
        own = free.pop(best)
        want.append((best, step, len(own & left)))
        left -= own
    for u in sorted(free, key=lambda u: (-round(sum(1 / n[t] for t in free[u]), 9), u))[: 12 - len(want)]:
        want.append((u, "rarity", 0))
    got = [(r["user_id"], r["step"], r["gain"]) for r in al.greedy_cover(events).orderBy("pos").collect()]
    assert got == want and len(got) == 12


def test_small_pieces_bound_rows_and_bytes():
    texts = ["x" * n for n in [10] * 700 + [400_000] * 9 + [3_000_000, 5]]
    whole = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    got = list(al.small_pieces(iter([whole.slice(0, 0), whole])))
    assert [t for b in got for t in b.column(0).to_pylist()] == texts
    assert all(b.num_rows <= al.PIECE and (b.nbytes <= al.HELD or b.num_rows == 1) for b in got)
