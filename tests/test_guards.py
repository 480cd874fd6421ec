import pytest

from wayfold.sources import guards

CODE = "def f(a, b):\n    return a + b  # sum\n"


def test_comments_and_spaces_keep_the_digest_and_all_else_changes_it():
    one = guards.code_digest({"m.py": CODE})
    same = ["def f(a, b):\n    # first\n\n    return a + b\n", "def f(a,b):\n        return a  +  b # other\n"]
    other = [CODE.replace("+", "-"), CODE.replace("b", "c"), CODE + "x = 1\n", "def f(a, b):\n    '''text'''\n    return a + b\n", CODE.replace("a + b", "(a + b)")]
    assert all(guards.code_digest({"m.py": s}) == one for s in same)
    assert len({one, *(guards.code_digest({"m.py": s}) for s in other)}) == len(other) + 1
    assert guards.code_digest({"n.py": CODE}) != one != guards.code_digest({"m.py": CODE}, ["numpy"]) != guards.code_digest({"m.py": CODE}, ["no-such-library"])
    # Tokens are told apart where their letters run together.
    assert guards.code_digest({"m.py": "ab = c\n"}) != guards.code_digest({"m.py": "a = bc\n"})


def test_files_are_read(tmp_path):
    path = tmp_path / "m.py"
    path.write_text(CODE)
    before = guards.code_digest([str(path)])
    path.write_text(CODE.replace("# sum", "# total"))
    assert guards.code_digest([str(path)]) == before
    path.write_text(CODE.replace("a + b", "a * b"))
    assert guards.code_digest([str(path)]) != before


def test_a_part_may_not_replace_the_whole():
    guards.check_output("out/schedule", "out/schedule", ["a", "b"], ["a", "b"])
    guards.check_output("out/part", "out/schedule", ["a"], ["a", "b"])
    with pytest.raises(ValueError, match="without b, c"):
        guards.check_output("file:out/schedule/", "out/schedule", ["a"], ["a", "b", "c"])
    with pytest.raises(ValueError, match="missing inputs: z"):
        guards.check_inputs(["a", "z"], ["a"])
