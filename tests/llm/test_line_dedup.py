from loglake.llm import line_dedup as L

BOILER = "Read more about our terms of use and privacy at any time"


def result(df):
    return {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["text"]) for x in df.collect()}


def test_recurring_templates(make_docs, words):
    own = [" ".join(words(20, s)) for s in range(11)]
    texts = {1: f"{own[0]}\n{BOILER}\n", 2: f"{BOILER}\n{own[1]}", 3: f"{own[2]}\n{BOILER}\n{BOILER}",
             4: f"Posted on 2024-01-05 by user 17 in the news section today\n{own[3]}",
             5: f"{own[4]}\nPosted on 2023-11-30 by user 9 in the news section today",
             6: f"{own[5]}\nDear reader called Alice we thank you for your kind visit here again",
             7: f"{own[6]}\nDear reader called Robert we thank you for your kind visit here again",
             8: None, 9: "", 10: "\n\n", 11: "short line\n" + own[7], 12: "short line\n" + own[8],
             13: "1 2 3 4 5 6 a\n" + own[9], 14: "7 8 9 10 11 12 a\n" + own[10]}
    got = result(L.dedup_lines(make_docs(texts)))
    assert got[1] == (3, 0, texts[1])
    assert got[2] == (2, 1, own[1]) and got[3] == (3, 2, own[2])
    assert got[4][1] == 0 and got[5] == (2, 1, own[4])
    assert got[6][1] == 0 and got[7] == (2, 1, own[6])  # one field generalised from the data
    assert got[8] == (0, 0, None) and got[9] == (1, 0, "") and got[10] == (3, 0, "\n\n")
    assert got[11][1] == got[12][1] == got[13][1] == got[14][1] == 0  # too short; rows of numbers


def test_short_lines_need_more_documents(make_docs, words):
    own = ["\n" + " ".join(words(20, s)) for s in range(12)]
    texts = {i: ("All rights reserved." if i < 3 else "two only" if i < 5 else "x") + f"\nPage {i} of {i * 7}\n{i} {i + 1}\n2024 1\n\n \n{i % 9} 5" + own[i] for i in range(12)}
    got = result(L.dedup_lines(make_docs(texts)))
    head, last = [got[i][2].split("\n")[0] for i in range(12)], [got[i][2].split("\n") for i in range(12)]
    assert head[0] == "All rights reserved." and "All rights reserved." not in got[1][2] + got[2][2]
    assert head[3] == head[4] == "two only"  # two documents are too few
    assert head[5] == "x" and not any("x" in x for x in last[6:])
    assert "Page 0 of 0" in last[0] and not any("Page" in got[i][2] for i in range(1, 12))
    assert "2024 1" in last[0] and not any("2024 1" in x for x in last[1:])
    assert all(f"{i} {i + 1}" in last[i] and f"{i % 9} 5" in last[i] and " " in last[i] and "" in last[i] for i in range(12))  # rows of numbers, blank lines


def test_copies_repeated_rows_and_long_texts(make_docs, words):
    text = "\n".join(" ".join(words(12, s)) for s in range(4000))
    docs = make_docs([(1, text), (2, text), (2, text), (3, "a b c d e f " * 50_000)])
    got = L.dedup_lines(docs).collect()
    assert sorted((x["doc_id"], x["n_dropped"]) for x in got) == [(1, 0), (2, 4000), (2, 4000), (3, 0)]
    assert all(x["text"] == "" for x in got if x["doc_id"] == 2)
    kept = L.clean_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(x["text"] for x in kept.collect()) == sorted([text] * 3 + ["a b c d e f " * 50_000])  # copies stay copies
    assert L.dedup_lines(make_docs({})).count() == 0


def test_clean_documents_keeps_columns(make_docs, words):
    a, b = (" ".join(words(40, s)) for s in (1, 2))
    docs = make_docs({1: f"{a}\n{BOILER}", 2: f"{b}\n{BOILER}"})
    got = {x["doc_id"]: x for x in L.clean_documents(docs).collect()}
    assert got[2]["text"] == b and got[2]["n_chars"] == len(b) and got[2]["gone"] == "x" and got[1]["text"].endswith(BOILER)


def test_documents_that_are_mostly_boilerplate_lose_it(make_docs, words):
    """50 to 80 % of recurring lines: no copies, so no later stage would take them."""
    shared = [" ".join(words(14, s)) for s in range(3)]
    for n_own in (1, 3):
        own = {i: "\n".join(" ".join(words(14, 100 * i + k)) for k in range(n_own)) for i in range(1, 5)}
        docs = make_docs({i: "\n".join([*shared, t]) for i, t in own.items()} | {9: "\n".join([*shared, own[2]])})
        got = {x["doc_id"]: x["text"] for x in L.clean_documents(docs).collect()}
        assert got == {1: "\n".join([*shared, own[1]]), 2: own[2], 3: own[3], 4: own[4], 9: own[2]}


def test_plan_is_native(spark, sf):
    plan = L.op5_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
