"""Gazetteer resolution vs a plain-Python statement of the rules, on composed address texts."""
import random

import regex

from mailsift.operators.gazetteer import gazetteer_hits, resolve_locations
from mailsift.plans.q_gazetteer import GAZETTEER, gazetteer_df

W = r"[\p{L}\p{N}_]"
WS = "[\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def found(v, text):
    return regex.search(rf"(?<!{W}){regex.escape(v)}(?!{W})", text) is not None


def adjacent(c, text):
    q = regex.escape(c)
    b, e = rf"(?:^|[^\p{{L}}\p{{N}}_])", rf"(?:[^\p{{L}}\p{{N}}_]|$)"
    for r in [r"[0-9]+", r"[0-9]+(?:st|nd|rd|th)", r"[a-zA-Z]"]:
        if regex.search(f"{b}{r}{WS}+{q}{e}|{b}{q}{WS}+{r}{e}", text):
            return True
    return False


def spec(text):
    results = []
    for cp, (cname, caliases, states) in enumerate(GAZETTEER):
        C = []
        for _, _, cities in states:
            for c in cities:
                if found(c, text) and c not in C:
                    C.append(c)
        S = []
        if C:
            for c in C:
                for sname, saliases, cities in states:
                    if c in cities:
                        for v in [sname] + saliases:
                            if found(v, text) and v not in S:
                                S.append(v)
            cities = ([c for sname, saliases, scities in states if set([sname] + saliases) & set(S)
                       for c in C if c in scities] if S else list(C))
        else:
            for sname, saliases, _ in states:
                for v in [sname] + saliases:
                    if found(v, text) and v not in S:
                        S.append(v)
            cities = []
        countries = []
        if S:
            for v in [cname] + caliases:
                if found(v, text) and v not in countries:
                    countries.append(v)
        contained = {c for c in cities for o in cities if o != c and c in o}
        cities = [c for c in cities if c not in contained and not adjacent(c, text)]
        keys = {"city": cities, "state": S, "country": countries}
        n = sum(1 for v in keys.values() if v)
        if n:
            results.append((cp, n, keys))
    if len(results) > 1 and min(r[1] for r in results) < max(r[1] for r in results):
        best = max(r[1] for r in results)
        results = [next(r for r in results if r[1] == best)]
    return {(cp, kind, tuple(vals)) for cp, _, keys in results for kind, vals in keys.items() if vals}


def _texts(n=120, seed=11):
    rnd = random.Random(seed)
    vocab = sorted({s for c, a, st in GAZETTEER for s in [c, *a] + [x for sn, sa, cs in st for x in [sn, *sa, *cs]]})
    filler = ["the", "at", "12", "3rd", "N", "and", "Street", "\n", ",", "-", "Orrex", "é"]
    out = []
    for i in range(n):
        words = [rnd.choice(vocab if rnd.random() < 0.45 else filler) for _ in range(rnd.randint(1, 12))]
        out.append((i, " ".join(words)))
    return out


def test_resolution_matches_spec(spark):
    cases = _texts()
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    gaz = gazetteer_df(spark)
    locs = resolve_locations(gazetteer_hits(docs, gaz)).collect()
    got = {}
    for r in sorted(locs, key=lambda r: (r.doc_id, r.country_pos, r.kind, r.rank)):
        got.setdefault(r.doc_id, {}).setdefault((r.country_pos, r.kind), []).append(r.surface)
    for i, text in cases:
        mine = {(cp, kind, tuple(v)) for (cp, kind), v in got.get(i, {}).items()}
        assert mine == spec(text), text


def test_a_piece_goes_to_the_join_once_for_a_text():
    # every place of a word was a row of the join
    import pyarrow as pa
    from mailsift.operators.gazetteer import _gram_rows
    shapes = [{"n": 1, "lead": 0, "tail": 0}, {"n": 2, "lead": 0, "tail": 0}, {"n": 1, "lead": 0, "tail": 1}]
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array(["Rome. Rome Paris, 12 Rome Paris"]), pa.array([shapes])], names=["id", "t", "shapes"])
    got = [tuple(r.values()) for b in _gram_rows(iter([batch])) for r in b.to_pylist()]
    assert sorted(got) == [(7, "12", 18, False), (7, "12 Rome", 18, False), (7, "Paris", 11, False), (7, "Paris,", 11, True),
                           (7, "Paris, 12", 11, False), (7, "Rome", 0, True), (7, "Rome Paris", 6, True), (7, "Rome.", 0, False), (7, "Rome. Rome", 0, False)]


def test_kinds_of_characters_are_those_of_the_patterns():
    from mailsift import settings as S
    from mailsift.operators.segment import blank_separated, text_units, word_runs
    rnd = random.Random(2)
    for _ in range(2000):
        t = "".join(rnd.choice(" \n\t\x0b\x85\u2028aB9._,!?-é²Š中٣𝒳😀ª") for _ in range(rnd.randint(0, 40)))
        assert list(zip(*word_runs(t))) == [m.span() for m in regex.finditer(S.WORD_PATTERN, t)]
        assert list(zip(*blank_separated(t))) == [m.span() for m in regex.finditer(r"[^ \t\n\r\f]+", t)]
        assert [n for n, _, _ in text_units(t, 99)] == [len(regex.findall(S.TOKEN_PATTERN, m.group())) for m in regex.finditer(S.SENTENCE_PATTERN, t)]
