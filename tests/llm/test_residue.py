import itertools
import re
from re import _parser

from rookery.llm import residue as rs

REAL = "The sorter at Elmstow logged 31 pallets. " * 20
CASES = [
    (f"{REAL} Contact {{{{first_name}}}} today.", True), (f"{REAL} Valid from ${{date}} on.", True), (f"{REAL} Dear <%= name %>, hello.", True), (f"{REAL} Site: [INSERT SITE]", True), (f"{REAL} hold the <link> cascade", True),
    (f"{REAL} Ticket __TICKET_ID__ covers it.", True), (f"{REAL} Hand it to «shift lead» now.", True), (f"{REAL} to *|NAME|* and #UNIT# here", True), (f"{REAL} %(site)s and %%UNIT%%", True),
    (f"{REAL}\nSemper lorem amet fauc sitan ornare consel magnis pretin.\n{REAL}", True), ("Text goes here.", True), ("Hier steht später ein Text.", True), ("ここに本文が入ります。", True), ("blah blah blah", True), ("Lorem ipsum dolor sit amet", True),
    ("Menu\nHome\n\nError 404: the page you asked for could not be found.\n\nImprint", True), ("Please enable JavaScript to view this page.", True), ("SEITE NICHT GEFUNDEN (FEHLER 404)", True), ("ページが見つかりません。", True),
    ('{"error": "upstream timeout", "status": 504}', True), ("Traceback (most recent call last):\n  File \"x.py\", line 3, in y\nKeyError: 'body'", True), ("java.lang.NullPointerException\n\tat a.b.C.d(C.java:3)", True), ("JavaScriptを有効にしてください。", True),
    (REAL, False), (f"{REAL} The template writes `{{{{first_name}}}}` there.", False), (f'{REAL} It prints "lorem ipsum" twice.', False), (f"{REAL} ```sh\nexport A=${{CELL}}\n``` done", False), (f"{REAL} An internal server error left 6 totes unassigned.", False),
    (f"{REAL} Error 404 was returned 52 times because the route was removed.", False), (f"{REAL} the set {{5, 26}} and `vector<int>` see [handover](x.md) [1][2]", False), (f"{REAL} Tablets ship with JavaScript disabled.", False), ("ok", False), ("", False), ("   ", False), (None, False),
    ("=" * 3000, False), ("_" * 3000, False), (f'{REAL} search for "[INSERT" and "TODO" first', False), ("long " * 60_000, False),
]


def test_cases(spark):
    rows = [(i, t, "web" if i % 3 else None, 0) for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, id int")
    got = {r.id for r in rs.without_content(rs.residue(df, "doc_id", "text", "source")).collect()}
    assert got == {i for i, (_, bad) in enumerate(CASES) if bad}


def test_furniture_is_subtracted(spark):
    nav = "\n".join(f"A long navigation entry number {'abcdefgh'[i]} of the portal" for i in range(8))
    message = "Your session has expired. Sign in again to continue."
    rows = [(i, f"{nav}\n{message}", "portal") for i in range(3)] + [(9, f"{nav}\n{message}", "elsewhere")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r.id for r in rs.without_content(rs.residue(df, "doc_id", "text", "source")).collect()}
    assert got == {0, 1, 2}


def test_furniture_with_identifiers_and_quotes(spark):
    lines = lambda i: "\n".join(f"Incident reference of the portal: SN{i}-90{i}67, desk Elm_{i}, \"as {i} told\" {'abcdefgh'[k]}" for k in range(5))
    alone = "\n".join(f"Pallet SN{i}-7{i} was held at dock {i} of the yard" for i in range(8))
    rows = [(i, f"{lines(i)}\nYour session has expired.", "portal") for i in range(1, 5)] + [(9, f"{lines(9)}\nYour session has expired.", "elsewhere"), (10, f"{alone}\nYour session has expired.", "yard")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    assert {r.id for r in rs.without_content(rs.residue(df, "doc_id", "text", "source")).collect()} == {1, 2, 3, 4}


def test_latin_beginnings(spark):
    df = spark.createDataFrame([(0, f"{REAL}\nSit elit tempor nisi sint anim", "a"), (1, f"{REAL}\nlaboris quid nisi sint anim", "a")], "doc_id int, text string, source string")
    assert {r.id for r in rs.without_content(rs.residue(df, "doc_id", "text", "source")).collect()} == {0, 1}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id int, text string, source string")
    assert rs.without_content(rs.residue(df, "doc_id", "text", "source")).count() == 0


def samples(parsed):
    """Strings of every alternative of a parsed pattern; look-arounds and anchors are left out."""
    parts = []
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                parts.append([chr(arg)])
            case "NOT_LITERAL" | "ANY":
                parts.append(["x"])
            case "IN":
                parts.append([member(*x) for x in arg][:4] if str(arg[0][0]) != "NEGATE" else ["x"])
            case "BRANCH":
                parts.append([x for branch in arg[1] for x in samples(branch)])
            case "SUBPATTERN":
                parts.append(samples(arg[3]))
            case "MAX_REPEAT" | "MIN_REPEAT":
                least, most, inner = arg
                parts.append(list(dict.fromkeys(x * n for n in {least, min(most, least + 1)} for x in samples(inner)[: 3 if least > 1 else None])))
            case "AT" | "ASSERT" | "ASSERT_NOT":
                pass
            case _:
                raise ValueError(op)
    assert len(list(itertools.islice(itertools.product(*parts), 100_001))) <= 100_000
    return list(dict.fromkeys("".join(x) for x in itertools.product(*parts)))


def member(op, arg):
    match str(op):
        case "LITERAL":
            return chr(arg)
        case "RANGE":
            return chr(arg[0])
        case _:
            return {"CATEGORY_SPACE": "\t", "CATEGORY_DIGIT": "5", "CATEGORY_WORD": "w", "CATEGORY_NOT_WORD": "-"}[str(arg)]


def test_every_alternative_has_a_sign():
    for bit, patterns in ((1, rs.PLACEHOLDERS), (2, rs.FILLERS), (4, [*rs.ERRORS, *rs.SCRIPTS, "\u0002"])):
        for pattern in patterns:
            found = samples(_parser.parse(re.sub(r"\\p\{Ll?\}", "a-z", pattern)))
            assert found and not [x for x in found if not rs.signs_in(x) & bit], pattern


def test_signs_of_every_alternative_count(spark):
    frames = "\n".join(f"\tat corvid.panel.Page{i}.render(Page{i}.java:{i})" for i in range(30))
    files = "\n".join(f"  File '/srv/panel/render{i}.py', line {i}, in view" for i in range(30))
    cases = [
        "This page doesn't exist.", "The page was moved.", f"{REAL}\nAdd title", f"{REAL}\nAdd content here", "Add caption", "Add summary", "Add introduction", "test\ttest", "Text de remplissage", "JAVASCR\u0130PT REQUIRED",
        f"java.lang.NullPointerException\n{frames}", frames, f"Traceback (most recent call last):\n{files}\nKeyError: 'body'", files,
    ]
    real = [f"{REAL}\n{frames}", "The pallet arrived at Elmstow (dock 3). " * 9, f"File the report on line 3 of the form. {REAL}"]
    df = spark.createDataFrame([(i, t, f"host {i}") for i, t in enumerate(cases + real)], "doc_id int, text string, source string")
    assert {r.id for r in rs.without_content(rs.residue(df, "doc_id", "text", "source")).collect()} == set(range(len(cases)))
