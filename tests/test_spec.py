import pytest

from panemill.plans.spec import JavaRandom, QuerySpec, concurrent, java_hash, parse_window, parse_windows, session, sliding, tumbling


def test_windows_from_text():
    assert parse_windows("TUMBLING,100,0;SLIDING,100,50,1;SESSION,60,2;TUMBLING,3,0,COUNT") == [tumbling(100, 0), sliding(100, 50, 1), session(60, 2), tumbling(3, 0, "COUNT")]
    assert parse_window("TUMBLING,100") == tumbling(100, -1)
    assert parse_window("SLIDING,5,2,9,COUNT") == sliding(5, 2, 9, "COUNT")


@pytest.mark.parametrize("text", ["", "HOPPING,1", "TUMBLING", "TUMBLING,0", "SESSION,5,1,COUNT", "TUMBLING,5,1,ROWS", "SLIDING,5"])
def test_not_a_window(text):
    with pytest.raises(ValueError):
        parse_window(text)


def test_query_needs_windows_and_known_functions():
    with pytest.raises(ValueError):
        QuerySpec.parse("", "SUM")
    with pytest.raises(ValueError, match="unknown"):
        QuerySpec.parse("TUMBLING,5", "NO_SUCH")
    assert [f.name for f in QuerySpec.parse("TUMBLING,5", "SUM;SUM;MEDIAN").functions] == ["SUM", "SUM", "MEDIAN"]


def test_public_generator_values():
    # documented sequence of seed 42, and hashes of known strings
    random = JavaRandom(42)
    assert [random.below(10) for _ in range(5)] == [0, 3, 8, 4, 0]
    assert java_hash("hello") == 99162322 and java_hash("") == 0 and java_hash("polygenelubricants") == -(1 << 31)


def test_concurrent_windows():
    found = concurrent("CONCURRENT,10,TUMBLING,20000")
    assert [w.window_id for w in found] == list(range(1, 11))
    assert all(w.size % 100 == 0 and 100 <= w.size <= 20000 for w in found)
    assert found == concurrent("CONCURRENT,10,TUMBLING,20000")
    with pytest.raises(ValueError):
        concurrent("CONCURRENT,10,SLIDING,20000")


def test_panes():
    assert QuerySpec.parse("TUMBLING,600;SLIDING,500,150,1;SESSION,7;TUMBLING,11,3,COUNT", "SUM").pane_ms() == 50
