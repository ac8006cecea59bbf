"""Signature re-alignment against an independent Python statement of the algorithm."""
import random


from mailsift.operators.align import align


def spec(text, resp):
    r = (resp or "").strip()
    if len(r) < 10:
        return (text, "", "", -1, -1)
    parts = [p for p in r[1:-1].strip().split(" ") if p]
    occ = []
    for p in parts:
        pos, offs = 0, []
        while True:
            j = text.find(p, pos)
            if j < 0:
                break
            offs.append(j)
            pos = j + len(p)
        if offs:
            occ.append((p, offs))
    if not occ:
        return (text, "", "", -1, -1)
    m = min(len(o) for _, o in occ)
    lists = [[o[-1]] if (m > 1 and len(o) == m) else o for _, o in occ]
    a = next(i for i, o in enumerate(lists) if len(o) == 1)
    lo = hi = lists[a][0]
    for o in reversed(lists[:a]):
        below = [x for x in o if x < max(0, lo - 1)]
        lo = max(below) if below else lo
    for o in lists[a + 1:]:
        above = [x for x in o if x > min(len(text), hi + 1)]
        hi = min(above) if above else hi
    hi = min(hi + len(occ[-1][0]), len(text))
    pre = text[:lo].split("\n")[-1]
    suf = text[hi:].split("\n")[0]
    return ("\n".join(text[:lo].split("\n")[:-1]), pre + text[lo:hi] + suf, "\n".join(text[hi:].split("\n")[1:]), lo, hi)


def _cases(n=150, seed=3):
    rnd = random.Random(seed)
    words = ["Ann", "Lee", "ann@x.io", "+1", "555", "Acme", "Inc.", "Regards,", "the", "a", "aa", "é😀", "--"]
    out = []
    for i in range(n):
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 8))]
        text = "\n".join(lines)
        k = rnd.randint(0, max(0, len(text) - 1))
        resp = text[k:k + rnd.randint(0, 60)]
        if rnd.random() < 0.2:
            resp = "x" + resp.replace("Acme", "Acne") + "y"
        out.append((i, text, resp))
    return out


def test_alignment_matches_spec(spark):
    cases = _cases()
    df = spark.createDataFrame(cases, "id int, text string, resp string")
    got = {r.id: tuple(r.a) for r in align(df, "text", "resp", "a").select("id", "a").collect()}
    for i, text, resp in cases:
        assert got[i] == spec(text, resp), (text, resp)


def test_long_signatures_take_a_pass_and_no_pattern_for_each_chunk(spark):
    # a text without line breaks has its whole window as signature; every chunk was a pattern run over the whole text
    import time
    long = " ".join(f"w{i}x" for i in range(6000))
    df = spark.createDataFrame([(i, f"t{i} {long}", long) for i in range(24)], "id int, text string, resp string").repartition(8)
    begun = time.monotonic()
    got = align(df, "text", "resp", "a").select("id", "a").collect()
    assert time.monotonic() - begun < 15  # 25.6 s on 8 cores with a pattern for each chunk, 3.7 s without
    assert len(got) == 24
    for r in got[:2]:
        assert tuple(r.a) == spec(f"t{r.id} {long}", long)


def test_bounds_need_no_list_of_all_places():
    # a chunk that occurs often is searched near the walk, not listed over the whole text
    import time
    from mailsift.operators.align import signature_bounds
    words = [f"{a}{b}{a}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    text = " ".join(words * 2000) + " marker9 " + " ".join(words)
    begun = time.monotonic()
    assert signature_bounds(text, " ".join(["a", "marker9", *words, "x"])) is not None
    assert time.monotonic() - begun < 1.5


def test_bounds_of_overlapping_chunks_match_spec():
    from mailsift.operators.align import signature_bounds
    rnd = random.Random(5)
    for _ in range(4000):
        text = "".join(rnd.choice("aab  ") for _ in range(rnd.randint(0, 60)))
        resp = text[rnd.randint(0, 30):][:rnd.randint(0, 40)] if rnd.random() < 0.7 else "".join(rnd.choice("aab x") for _ in range(30))
        got, want = signature_bounds(text, resp), spec(text, resp)
        assert (got is None) == (want[3] == -1)
        if got is not None:
            assert got[0] == want[3]
