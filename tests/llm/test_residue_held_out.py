"""Cases written without looking at any table; README states how many of them are found."""

from rookery.llm import residue as rs

REAL = "The ferry to the northern islands leaves at seven and returns in the late afternoon with mail and fresh bread. " * 4
BAD = [
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.",
    "At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum.",
    f"{REAL}\nPellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.\n{REAL}",
    "TODO TBD add copy",
    "TBD",
    "FIXME: write section here",
    "Nie znaleziono strony. Wróć do strony głównej.",
    "Sidan kunde inte hittas. Gå till startsidan.",
    "Une erreur est survenue. Veuillez réessayer plus tard.",
    "Siden findes ikke længere.",
    "Sivua ei löytynyt.",
    "Stránka nebyla nalezena.",
    "Sayfa bulunamadı.",
    "Сторінку не знайдено.",
    "Произошла ошибка. Попробуйте позже.",
    "发生错误,请稍后再试。",
    "找不到此页面",
    "Aktivera JavaScript för att fortsätta.",
    "Włącz obsługę JavaScript w przeglądarce.",
    "This app works best with JavaScript enabled.",
    "You need to enable JavaScript to run this app.",
    "502 Bad Gateway\nnginx/1.18.0",
    "HTTP Error 503. The service is unavailable.",
    "Sorry, we can't find that page. It may have been deleted.",
    "Verify you are human by completing the action below.",
    "An error occurred while processing your request.",
    "403 Forbidden\nYou don't have permission to access this resource.",
    "Dieser Text ist ein Blindtext.",
    "Tu wpisz tekst",
    "Placeholder text",
    f"{REAL} Dear {{{{ customer.first_name }}}}, your order has shipped.",
    f"{REAL} Kind regards, [Your Name]",
    f"{REAL} Price: ${{price}} per night.",
    f"{REAL} Call us at [INSERT PHONE NUMBER].",
    f"{REAL} Hello %%FIRSTNAME%%, welcome back.",
    f"{REAL} The <COMPANY NAME> team",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser.",
    "Oops, that link is broken.",
    "Nothing to see here yet. Check back soon!",
    "Site en construction",
    "Access to this resource on the server is denied!",
    "Fatal error: Uncaught Error: Call to undefined function",
    "Warning: mysql_connect(): Access denied for user 'root'@'localhost'",
    "Type your paragraph here",
    "xxxxx xxxxx xxxxx xxxxx",
]
GOOD = [
    REAL,
    f"{REAL} The page about tides was moved to a new binder, and nobody could find it for a week.",
    "Our office opens at nine.",
    f'{REAL} The form letter said "Dear [Your Name]" and nobody noticed.',
    f"{REAL} In Italian, massa means mass and porta means door.",
    "Die Fähre fährt um sieben Uhr ab und kommt am Abend wieder.",
    f"{REAL} We fixed the internal server error that had kept guests from booking since Monday.",
    f"{REAL} Use `{{{{ name }}}}` to greet guests.",
]


def found(spark, texts):
    df = spark.createDataFrame([(i, t, f"host {i}") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    return {r.id for r in rs.without_content(rs.residue(df, "doc_id", "text", "source")).collect()}


def test_held_out_recall(spark):
    got = found(spark, BAD)
    print(sorted(set(range(len(BAD))) - got))
    assert len(got) >= 0.8 * len(BAD)


def test_real_texts_stay(spark):
    assert found(spark, GOOD) == set()


def test_site_wide_evidence_is_furniture(spark):
    body = "Berth {0} was dredged by crew {1} ahead of the spring tide; soundings at {2} are kept in the harbour log."
    name = lambda i: "".join(chr(97 + (i * 7 + k * 3) % 26) for k in range(6))
    rows = [(i, f"{body.format(name(i), name(i + 9), name(i + 31))}\n© {{{{year}}}} Harbour office", "year") for i in range(50)]
    rows += [(100 + i, f"{body.format(name(i), name(i + 9), name(i + 31))[:70]}\nPlease enable JavaScript to view comments.", "comments") for i in range(50)]
    rows += [(200 + i, "Menu\nImprint\nError 404: page not found", "down") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r.id: r.reason for r in rs.without_content(rs.residue(df, "doc_id", "text", "source")).collect()}
    assert got == {200 + i: "furniture" for i in range(40)}


def test_one_document_makes_no_furniture(spark):
    text = "\n".join(f"Shift {i}" for i in range(2, 7)) + "\nThe night crew cleaned the quay, counted ropes, refilled lamps, and wrote a long note about the broken winch near the old customs shed.\nYour session has expired."
    assert found(spark, [text]) == set()


def test_factors_hold_in_every_match():
    assert rs.factors(r"\bfoo (?:bar|bazaar)\b") == {"foo ba"}
    assert rs.factors(r"(?i:ABC)\d?") == {"abc"} and rs.factors(r"\d+|abc") is None and rs.factors(r"(?:x|yy)+z*") == {"x", "yy"}
