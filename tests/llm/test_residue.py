import pytest

from pagequarry.llm import residue as R

PROSE = "The committee met again in spring and agreed on a budget. " * 12


@pytest.mark.parametrize(
    "text",
    ["{{ name }}", "{% block x %}", "<%= price %>", "${user}", "%%CITY%%", "[[NAME]]", "[INSERT DATE]", "[Your company here]", "*|FNAME|*", "__TITLE__", "#OFFER#", "@city@", "XXXX-NAME-XXXX", "&lt;phone&gt;", "<AUTHOR>", "{first_name}", "$(city)", "@@city@@", "##CITY##", "#{name}", "{$name}", "<<name>>", '[price_shortcode id="7"]', "%location%"],
)
def test_placeholders(text):
    assert R.examine(f"# Head\n\n{PROSE}{text} and more of it.")[0] == "placeholder"
    assert R.examine(f"# Head\n\n{PROSE}`{text}` and more of it.\n\n```\n{text}\n```")[0] is None


@pytest.mark.parametrize("text", ["[1]", "[back](/blog/)", "100% of 5% sales", "a < b and c > d", "<b>bold</b> <br>", "{1}", "#tag", "me@example.com", "5 # 6 # 7", "snake__case__name"])
def test_no_placeholders(text):
    assert R.examine(f"{PROSE}{text} {PROSE}")[0] is None


def test_filler_and_prompts():
    lorem = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor."
    assert R.examine(f"# A\n\n{PROSE}\n\n{lorem}")[0] == "filler"
    assert R.examine(f"# A\n\n{lorem.replace('Lorem ipsum ', '')}")[0] == "filler"
    assert R.examine(f"Designers use lorem ipsum so that nobody argues about wording. {PROSE}")[0] is None
    assert R.examine(f"# A\n\n{PROSE}\n\nClick here to edit this text box.")[0] == "prompt"
    assert R.examine("Hier steht später Ihr Text.")[0] == "prompt"


def cases(spark, rows, **options):
    df = spark.createDataFrame(rows, "id long, url string, text string, host string")
    return {r["id"]: r["reason"] for r in R.residue(df, "id", "url", "text", **options).collect()}


def test_error_pages_but_not_texts_about_errors(spark):
    rows = [
        (1, "https://a.example/", "# Oops\n\nThe page you requested could not be found.", "h"),
        (2, "https://b.example/", "Fehler 404: Unter dieser Adresse gibt es nichts mehr.", "h"),
        (3, "https://b.example/", f"The phrase page not found makes people leave. {PROSE}", "h"),
        (4, "https://c.example/", "# Access denied", "h"),
        (5, "https://c.example/", "# Reading list\n\nThree short books.", "h"),
        (6, None, "Please enable JavaScript to view this site.", "h"),
        (7, "https://c.example/", None, "h"),
        (8, "https://c.example/", "", "h"),
        (8, "https://c.example/", "", "h"),
        (9, "https://c.example/", "# Guide\n\n```\ncurl -I /old   # answers 404 Not Found\n```\n\n" + PROSE, "h"),
        (1, "https://a.example/", "# Oops\n\nThe page you requested could not be found.", "h"),
    ]
    assert cases(spark, rows) == {1: "error", 2: "error", 4: "error", 6: "error"}


def test_prompts_in_long_paragraphs():
    wix = "I'm a paragraph. Click here to add your own text and edit me. It's easy. Let your users know a little more about you, tell a story and drag me anywhere you like on this page."
    assert R.examine(f"# A\n\n{wix}")[0] == "prompt" and R.examine(f"# A\n\n{PROSE}\n\n{wix}")[0] == "prompt"
    about = f"Editors leave placeholder text behind, and a button says “click here to edit” for years. {PROSE}"
    assert R.examine(f"# A\n\n{about}")[0] is None


def test_error_messages_in_long_paragraphs_and_pages(spark):
    own = "Sorry, the page you asked for at Harbour Lane Books could not be found. Our shelves were rearranged in the spring and some of the addresses changed with them."
    long = "The page you requested could not be found on this server, and nothing else is kept at this address either. " * 2
    long = "\n\n".join(long.replace("server", f"server of {n}") for n in ("Ames", "Bode", "Cole"))
    rows = [
        (1, "https://a.example/", f"# Page not found\n\n{own}", "h"),
        (2, "https://a.example/", f"# Page not found\n\n{long}\n\nTry the start page of the shop.", "h"),
        *((k, f"https://h{k}.example/", f"# Page not found\n\nThe phrase page not found makes people leave. {PROSE}", "h") for k in range(3, 8)),
    ]
    assert cases(spark, rows) == {1: "error", 2: "error"}


SURE = ["404 not found", "Die Seite wurde nicht gefunden", "please enable javascript", "Fehler 404", "http 404", "the page could not be found", "can't find that page", "page not found", "la página no existe", "la page est introuvable",
    "La pagina richiesta non è stata trovata", "access is denied", "Accès interdit", "Zugriff gesperrt", "Confirm that you are not a robot.", "Your session has expired", "log in to continue", "down for maintenance", "site en maintenance",
    "this page needs JavaScript", "JavaScript is disabled", "bad gateway", "500 Internal Server Error", "Diese Adresse existiert nicht", "esta página não existe", "the link is broken", "the page no longer exists", "verify you are human"]


@pytest.mark.parametrize("text", SURE)
def test_words_looked_for_first_are_in_every_match(text):
    masked, bits = R.Messages()(text)
    assert R.ERROR.search(masked) and bits & 16 and any(x in masked for x in R._ERROR_LITERALS)


def test_masks():
    assert R.mask("## **Call** 555-0101 on 12/05/2024, ref f3de09") == "call 0 on 0, ref 0"
    assert R.mask("- see https://a.example/x or write to me@b.example") == "see <u> or write to <u>"


def test_recurrence_decides_where_no_list_knows_the_language(spark):
    dutch = "# 404\n\nDeze bladzijde bestaat niet meer, kijk op de startbladzijde."
    rows = [(k, f"https://h{k}.example/", dutch, "x") for k in range(3)]
    assert cases(spark, rows) == {0: "error", 1: "error", 2: "error"} and cases(spark, rows[:2]) == {} and cases(spark, rows, min_hosts=9) == {}


def test_recurring_prompts_but_not_in_headings(spark):
    rows = [(k, f"https://h{k}.example/", f"# Why replace a box\n\n{PROSE}\n\nPlease replace these lines by a fine description.", "x") for k in range(3)]
    assert cases(spark, rows) == {0: "prompt", 1: "prompt", 2: "prompt"} and cases(spark, rows[:1]) == {}
    assert cases(spark, [(k, u, t.rsplit("\n\n", 1)[0], h) for k, u, t, h in rows]) == {}


def test_recurrence_decides_doubtful_messages(spark):
    doubtful = "Our server is taking a nap, try again."
    rows = [(k, f"https://h{k}.example/", f"# Hm\n\n{doubtful}", "x") for k in range(4)]
    assert set(cases(spark, rows)) == {0, 1, 2, 3}
    assert cases(spark, rows[:1]) == {} and cases(spark, [(k, "https://one.example/", t, h) for k, _, t, h in rows]) == {}


def test_empty_tables_and_real_pages(spark):
    df = spark.createDataFrame([(1, "https://a.example/", "Zugriff verweigert.", "k"), (2, "https://a.example/", PROSE, "k"), (3, None, None, None)], "id long, url string, text string, reason string")
    kept = R.real_pages(df, "id", "url", "text")
    assert {r["id"] for r in kept.collect()} == {2, 3} and kept.columns == df.columns
    assert R.residue(df.limit(0), "id", "url", "text").count() == 0


def test_very_long_text():
    assert R.examine("word " * 300_000)[0] is None
    assert R.examine("{" * 20_000)[0] is None and R.examine("[" * 20_000)[0] is None
