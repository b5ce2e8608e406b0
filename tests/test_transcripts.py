"""H5, H6, H7, H11, H12, L11, M1 rules (FIXTURES.md §2)."""

from tessera.operators import summarise as sm
from tessera.operators import transcript as tr


def test_needs_user_input_cases(spark):
    threads = spark.createDataFrame([(i,) for i in range(1, 7)], "thread_id long")
    msgs = spark.createDataFrame([(2, 1, "content-reviewer-agent"), (3, 1, "REVIEW-bot"), (4, 1, None),
                                  (5, 1, ""), (6, 1, "web_content_collect_agent")],
                                 "thread_id long, turn long, name string")
    got = {r.thread_id: (r.needs_input, r.reason) for r in tr.needs_user_input(threads, msgs).collect()}
    assert got[1] == (False, tr.REASON_EMPTY)
    assert got[2] == (True, tr.REASON_REVIEWER) and got[3] == (True, tr.REASON_REVIEWER)
    assert all(got[i] == (False, tr.REASON_OTHER) for i in (4, 5, 6))


def test_render_message(spark):
    items = "array<struct<function_name:string, arguments:string>>"
    df = spark.createDataFrame([(None, "hello", None), ("a", None, [("f", "x=1"), ("g", "")]), ("b", "", [])],
                               f"name string, content string, items {items}")
    got = [(r.speaker, r.body) for r in tr.render_message(df).collect()]
    assert got == [("(unknown)", "hello"), ("a", "Function: f\nArguments: x=1\nFunction: g"), ("b", "")]


def test_assemble_chunks_cases(spark):
    rows = [(1, 1, "He", False), (1, 2, "llo", True), (1, 3, "A", False), (1, 4, "B", True), (1, 5, "open", False),
            (2, 2, "b", True), (2, 1, "a", False)]
    df = spark.createDataFrame(rows, "s long, seq long, content string, is_final boolean")
    got = sorted((r.s, r.msg_no, r.content, r.n_chunks) for r in tr.assemble_chunks(df, "s", ["seq"]).collect())
    assert got == [(1, 1, "Hello", 2), (1, 2, "AB", 2), (2, 1, "ab", 2)]


def test_conversation_end(spark):
    rows = [(1, 0, "user", "n"), (1, 1, "assistant", "x"), (1, 2, "user", " N "), (1, 3, "assistant", "y"),
            (2, 0, "user", "q"), (2, 1, "user", "no"), (2, 2, "user", "next"), (3, 0, "user", "q"),
            (3, 1, "user", " \n\t "), (3, 2, "assistant", "z")]
    df = spark.createDataFrame(rows, "thread_id long, turn long, role string, text string")
    kept = sorted((r.thread_id, r.turn) for r in tr.conversation_end(df).collect())
    assert kept == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0)]


def test_iteration_decision_table(spark):
    rows = [(1, 1, 0.80), (2, 1, 0.79), (3, 1, 0.1), (3, 2, 0.75), (4, 1, 0.1), (4, 2, 0.74), (4, 3, 0.70),
            (5, 1, 0.1), (5, 2, 0.1), (5, 3, 0.69), (5, 4, 0.10)]
    df = spark.createDataFrame(rows, "thread_id long, turn long, quality double")
    got = {(r.thread_id, r.turn): (r.iteration, r.approved, r.emitted_quality)
           for r in tr.iteration_decision(df).collect()}
    assert got[(1, 1)] == (1, True, 0.80) and got[(2, 1)] == (1, False, 0.79)
    assert got[(3, 2)] == (2, True, 0.75) and got[(4, 2)] == (2, False, 0.74)
    assert got[(4, 3)] == (3, True, 0.70) and got[(5, 3)] == (3, False, 0.69)
    assert got[(5, 4)] == (4, True, 0.80)


def test_size_route_and_next_agent(spark):
    df = spark.createDataFrame([(49,), (50,), (51,)], "n_results long")
    assert [r.route for r in sm.size_route(df).orderBy("n_results").collect()] == \
        ["credibility", "credibility", "summarise"]
    st = spark.createDataFrame([("DataFeederAgent", 51, True, "en", False), ("ReflectionCriticAgent", 0, False, "en", False),
                                ("ReflectionCriticAgent", 0, True, "en", False), ("ReflectionCriticAgent", 0, True, "zh", False),
                                ("ReflectionCriticAgent", 0, True, "en", True), ("TranslatorAgent", 0, True, "en", True)],
                               "agent string, n_results long, approved boolean, report_lang string, translated boolean")
    assert [r.next_agent for r in tr.next_agent(st).collect()] == \
        ["SummarizerAgent", "ReportWriterAgent", "TranslatorAgent", "done", "done", "done"]


def test_iteration_marker_and_polls(spark):
    df = spark.createDataFrame([("ITERATION_COUNT:3 go",), ("none",)], "text string")
    assert [r.marker for r in tr.iteration_marker(df).collect()] == [3, None]
    polls = spark.createDataFrame([(1, 1, None), (1, 2, 10), (1, 3, 10), (1, 4, None), (1, 5, 11), (1, 6, 10)],
                                  "t long, p long, msg_id long")
    got = [r.emitted for r in tr.new_message_polls(polls, "t", ["p"]).orderBy("p").collect()]
    assert got == [False, True, False, False, True, True]
