import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T


@pytest.fixture(scope="module")
def one(spark):
    def run(f, text, *more):
        return spark.createDataFrame([(text, *more)], ", ".join(f"{c} string" for c in "cxyz"[: 1 + len(more)])).select(f(*(F.col(c) for c in "cxyz"[: 1 + len(more)]))).first()[0]

    return run


def targets(one, text):
    return [(x.target, x.alias) for x in one(T.wikilinks, text)]


def test_wikilinks(one):
    assert targets(one, "[[My Note]]") == [("My Note", None)]
    assert targets(one, "[[path/to/note|Display Text]]") == [("path/to/note", "Display Text")]
    assert targets(one, "[[A]] and [[B|b]] then [[C]]") == [("A", None), ("B", "b"), ("C", None)]
    assert targets(one, "[[]] and [[  ]]") == []
    assert targets(one, "[[Real Link]]\n```bash\nif [[ -f file ]]; then\n```\n```yaml\n[[providers]]\n```\n") == [("Real Link", None)]
    assert targets(one, "[[outside]]\n~~~\n[[in]]\n```\n[[still]]\n~~~\n[[after]]\n  ```\n[[open]]") == [("outside", None), ("after", None)]


def test_fences_against_a_line_machine(one):
    import random

    def model(text):
        out, fence = [], None
        for line in text.split("\n"):
            mark = line.lstrip()[:3]
            if fence:
                fence = None if mark == fence else fence
            elif mark in ("```", "~~~"):
                fence = mark
            else:
                out.append(line)
        return [x for x in out if x.startswith("[[")]

    rng = random.Random(1)
    for _ in range(40):
        text = "\n".join(rng.choice(["```", "~~~", "  ```x", "[[a]]", "t", "", "[[b]]", "``` `"]) for _ in range(rng.randrange(12)))
        assert [f"[[{t}]]" for t, _ in targets(one, text)] == model(text), repr(text)


def test_lines_and_words(one):
    assert one(T.lines, "a\r\nb\n\nc\n") == ["a", "b", "", "c"]
    assert one(T.lines, "") == [] and one(T.lines, "x") == ["x"] and one(T.lines, "\n") == [""]
    assert one(T.words, " a　b \n c ") == ["a", "b", "c"]


def test_frontmatter_readers(one):
    assert one(T.frontmatter, "---\na: 1\n---\nbody\n") == "a: 1" and one(T.body, "---\na: 1\n---\nbody\n") == "body\n"
    assert one(T.body, "---\n---\n") == "---\n---\n"
    got = one(T.split_frontmatter, "---\r\ntitle: Hello\r\n---\r\nx")
    assert (got.yaml, got.body) == ("title: Hello", "x")
    assert one(T.split_frontmatter, "---\ntitle: Hello\n---").yaml == "title: Hello"
    assert one(T.split_frontmatter, "a\r\nb").body == "a\r\nb"
    assert one(T.strip_frontmatter, "---\na: x---\nb") == "b"
    assert one(lambda c: T.field(c, "genre"), "---\ngenre:  essay \n---\n") == "essay" and one(lambda c: T.field(c, "genre"), "genre: x") is None


def test_tags(one):
    assert one(T.inline_tags, "x: 1\ntags: [a, \"b\", 'c',, ]") == ["a", "b", "c"]
    assert one(T.listed_tags, "tags:\n  - a\n  - 'b'\naliases:\n  - z") == ["a", "b", "z"]
    assert one(T.listed_tags, "title: x") == []
    assert [one(T.normalized_tag, t) for t in ("Rust", "Machine Learning", "rust-lang")] == ["rust", "machine-learning", "rust-lang"]
    add = lambda y: one(lambda c: T.with_tags(c, F.array(F.lit("n$1"), F.lit("a"))), y)
    assert add("k: 1\ntags: [a]\nz: 2") == "k: 1\ntags: [a, n$1]\nz: 2"
    assert add("k: 1") == "tags: [n$1, a]\nk: 1"
    assert add("tags:\n  - b\nz: 1").startswith("tags: [b, n$1, a]") and "- b" not in add("tags:\n  - b\nz: 1")


def test_yaml_tags(one):
    pytest.importorskip("yaml")
    assert one(T.yaml_tags, "tags: [a, 1, b]") == ["a", "b"] and one(T.yaml_tags, "tags: foo") == [] and one(T.yaml_tags, "]:") == []


def test_titles_and_summaries(one):
    assert one(lambda c: T.title(c, F.lit("stem")), "x\n# # Title \ny") == "Title" and one(lambda c: T.title(c, F.lit("stem")), "##no") == "stem"
    assert one(lambda c: T.summary(F.lit(""), c), "\n# H\n  first para \nnext") == "first para"
    assert one(lambda c: T.summary(F.lit("summary: 'own one'"), c), "x") == "own one"
    for text in ("é" * 150, "漢" * 100, "😀" * 60, "a" * 199 + "é", "a" * 201):
        raw = text.encode()
        end = 200
        while end < len(raw) and (raw[end] & 0xC0) == 0x80:
            end -= 1
        want = text if len(raw) <= 200 else raw[:end].decode() + "..."
        assert one(lambda c: T.cut(c, 200), text) == want
    assert one(T.digest_lines, "---\n# h\na\n\nb\nc\nd") == "a b c"


def test_sections(one):
    put = lambda c: T.with_section(c, "## See Also", F.lit("## See Also\n- x"))
    assert one(put, "a\n## See Also\nold\n## Next\nb") == "a\n## See Also\n- x\n## Next\nb\n"
    assert one(put, "a\n") == "a\n## See Also\n- x"
    assert one(lambda c: T.without_sections(c, ["## A", "## B"]), "x\n## A\n1\n## C\n2\n## B\n3\n# D\n4\n") == "x\n## C\n2\n# D\n4\n"
    assert one(lambda c: T.preserved_sections(c, ["## A"]), "x\n## A\n1\n# sub\n## C\n2\n") == "\n## A\n1\n# sub\n"
    assert one(lambda c: T.preserved_sections(c, ["## A"]), "x") == ""
    assert one(T.capitalized_path, "deep dir/sub") == "Deep dir / Sub"


def test_malforms(one):
    assert one(T.glued_project, "---project: foo\nx") and not one(T.glued_project, "---\nproject: foo")
    assert one(T.unglued_project, "---project: foo\nx") == "---\nproject: foo\nx"
    assert one(T.broken_tag_list, "a\ntags:\nnext: 1\n") and not one(T.broken_tag_list, "tags:\n  - a\n") and not one(T.broken_tag_list, "tags:")
    assert one(T.mended_tag_list, "a\ntags:\nnext: 1\n") == "a\ntags: []\nnext: 1\n"
    assert one(T.mended_tag_list, "tags:\nnext") == "tags: []\nnext" and one(T.mended_tag_list, "x") == "x"
    assert one(T.empty_tags, "tags: []\n") and not one(T.empty_tags, "tags: [a]\n")
    assert one(T.malformed_line, "a: 1\ntags: [x]project: y") == "tags: [x]project: y" and one(T.malformed_line, "a") is None


def test_small_ones(one):
    swap = lambda c: T.replaced_link(c, F.lit("a.b"), F.lit("n$1"))
    assert one(swap, "[[a.b]] [[a.b|x]] [[axb]]") == "[[n$1]] [[n$1|x]] [[axb]]"
    assert one(T.link_encoded, "a b#c?d/é") == "a%20b%23c%3Fd/é"
    assert [one(lambda c, n=n: T.duration(F.lit(n)), "x") for n in (59, 60, 61, 3600, 3725, 90000)] == ["59s", "1m", "1m 1s", "1h", "1h 2m", "25h"]
    assert [one(lambda c, n=n: T.byte_size(F.lit(n)), "x") for n in (5, 1536, 3 << 20)] == ["5 B", "1.5 KB", "3.0 MB"]
    assert one(T.masked_key, "sk-1234567890") == "sk-1...7890" and one(T.masked_key, "short") == "****"
    assert one(lambda c: T.reassembled(F.lit("a: 1\n \n"), c), "b") == "---\na: 1\n---\nb"
