"""Template residue, filler and error pages, by messages masked, grouped across sources and classified.

A text without its code is read line by line. A line of up to `MESSAGE_WORDS` words is a message: its markup is
dropped, addresses, dates, reference codes and numbers are masked, and the hash of the rest is its group. Groups are
counted over all pages by the sources (hosts) they occur on, and then classified:

* a group on `MIN_HOSTS` sources or more recurs. Words that hint at an error or a demand for scripts make it an error
  message, words that hint at an edit of a text make it a prompt; a recurring group without such words belongs to no
  page in particular and is not counted as a page's own text;
* a group on fewer sources needs wording that is beyond doubt (`ERROR`, `PROMPT`).

A page with a prompt is a case. A page with an error message is one if the text of its own, in words that are neither
heading nor message, is no more than the messages' words or `OTHER_WORDS`; so is a page whose heading is an error
message and whose text recurs, in whatever language it is. Longer lines are text of their page even where they recur,
as whole articles are mirrored too; they are read sentence by sentence for wording beyond doubt.

Placeholders that were never filled and paragraphs of filler are cases on whatever page they stand, recurring or not:
the name filled in around them differs from page to page.

Only hashes of messages, sources and ids are shuffled, counted per message and source before they meet; hot messages
are salted in the join back to their pages.

Defined results: null texts are neither cases nor dropped by `real_pages`; an empty or blank text is no case; a page
with a null URL adds no source; repeated rows count once (by id); texts of any length are read whole; other columns
are kept by `real_pages`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .site_lines import host_of

MIN_HOSTS, SALTS = 3, 16
#: Words of a message at most; longer lines are text. Words of own text that a page may have beside its error message.
MESSAGE_WORDS, OTHER_WORDS = 24, 40
FILLER_SHARE, FILLER_WORDS = 0.6, 8
_CACHE_WORDS = 500_000

_FENCE = re.compile(r"^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\Z)", re.M | re.S)
_CODE_SPAN = re.compile(r"(`+)(?!`).+?(?<!`)\1(?!`)", re.S)
_INDENTED = re.compile(r"^(?: {4}|\t)[^\n]*$", re.M)

# Names of HTML elements that may stand in Markdown (fixed values).
_HTML = "a abbr article aside b blockquote br button caption center cite code col dd del details div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 header hr html i iframe img input ins kbd label legend li link main mark meta nav object ol option p path picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr body head address audio base canvas".split()

_NAME = r"[A-Za-z][\w.-]*"
PLACEHOLDER = re.compile(
    "|".join(
        (
            r"\{\{[^{}\n]{1,80}\}\}",  # mustache and its relatives
            r"\{%[^%\n]{1,80}%\}",
            r"<%[=-]?[^%\n]{1,80}%>",
            r"<\?(?:php|=)[^\n]{0,80}\?>",
            r"[$#!]\{[^{}\n]{1,60}\}",
            r"\$\([A-Za-z_][\w.]{1,40}\)",
            r"(?<![\w{])\{[$#:@*][A-Za-z_][\w.]{1,40}[#*]?\}",
            r"(?<![\w{$])\{[a-z][a-z0-9_.]{1,40}\}(?!\})",
            r"%%[A-Za-z][\w-]{1,40}%%",
            r"(?<![\w%])%[A-Za-z][A-Za-z_]{2,40}%(?![\w%])",
            r"\[\[[A-Za-z][\w ./:-]{0,60}\]\](?!\()",
            r"\*\|[A-Za-z][\w:-]*\|\*",
            r"(?<![\w#])#[A-Z][A-Z_]{2,40}#(?![\w#])",
            r"(?<![\w_])__[A-Z][A-Z0-9_]{2,40}__(?![\w_])",
            r"(?<![\w@])@{1,2}[A-Za-z][a-z_A-Z]{2,40}@{1,2}(?![\w@])",
            r"(?<![\w#])##[A-Za-z][\w-]{1,40}##(?![\w#])|(?<![\w|])\|\|[A-Za-z][\w-]{1,40}\|\|(?![\w|])|(?<![\w$])\$[A-Z][A-Z_]{2,40}\$(?![\w$])",
            r"<<[A-Za-z][\w .-]{1,40}>>|\(\([A-Z][A-Z_ ]{2,40}\)\)|\[%[^%\n]{1,80}%\]|<#[^#\n]{1,80}#>|\[:[a-z_]{2,40}:\]",
            r"\bX{3,}[-_][A-Z]+(?:[-_]X{3,})?\b",
            r"\[(?i:insert|enter|add|your|type|put|company|client|first|last|full|ihr|ihre|votre|su|tu|il tuo|o seu)\b[^\]\n]{0,60}\](?!\()",
            r"\[[A-Za-z]+ (?i:name|here|title|goes here|placeholder)\](?!\()",
            r"\[/?[a-z]+_[a-z_]+(?: [a-z_]+=[^\]\n]{1,60})*\](?!\()",
            r"&lt;/?[A-Za-z][\w ]{1,40}&gt;",
            r"<(?!/|(?:%s)\b|https?:|mailto:)[A-Za-z]{3,20}(?:[ _][A-Za-z]+)?>" % "|".join(_HTML),
            r"</?(?:NAME|TITLE|DATE|ADDRESS|TIME)>",
        )
    )
)
_PLACEHOLDER_TAG = re.compile(r"</?(?:time|title|address|label|link|font|object|source|summary|caption|legend|option)>", re.I)

#: The vocabulary of scrambled Latin filler (fixed values).
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "vivamus integer nec odio praesent libero cursus ante dapibus diam nibh elementum imperdiet augue semper porta mauris massa vestibulum lacinia arcu eget sociosqu litora torquent per conubia nostra curabitur sodales ligula pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas donec vitae sapien aenean proin phasellus suspendisse tincidunt".split()
)
_DUMMY = re.compile(r"\b(?:(?:blah|bla|asdf|qwerty|foo bar|test test|dummy text|lipsum)\b[ ,.]*){3,}|the quick brown fox jumps over|li europan lingues|far far away, behind the word mountains", re.I)

_WORD = re.compile(r"[^\W\d_]+")

PROMPT = re.compile(
    r"(?:sample|dummy|placeholder|filler|example|default|demo) (?:text|copy|content|paragraph|heading|title)\b"
    r"|(?:heading|title|text|content|copy|description|caption|subtitle|tagline|paragraph|image) (?:goes|comes|will go|will appear) here"
    r"|click (?:here )?to (?:edit|add|change)|click here to edit|double[- ]click to edit|edit (?:this|me)\b.{0,30}(?:text|box|block|section|paragraph)"
    r"|(?:type|write|enter|put|insert|add) your (?:own )?(?:text|paragraph|content|title|heading|description|copy|story|name)"
    r"|(?:add|write|insert|put) an? (?:short |brief )?(?:description|text|paragraph|title|caption|summary|bio)\b.{0,60}(?:here|this space|this section|this block|this area)"
    r"|your (?:text|title|heading|content|headline|copy|slogan|tagline) here|your first (?:entry|post|page|article)!|(?:change|edit|delete) (?:or|and) (?:remove|delete|change|start writing)\b.{0,40}"
    r"|^(?:todo|tbd|fixme|tk)\b\s*[:\-–]|do not publish|not for publication|replace (?:this|it|me) with your|replace this (?:text|paragraph|copy)|welcome to wordpress|^hello world!?$"
    r"|texto de (?:ejemplo|exemplo|relleno|muestra|prueba)|(?:texte|contenu|titre) (?:d[’']exemple|d[’']essai|de remplissage|provisoire)|votre (?:texte|titre|contenu) ici|texte à (?:remplacer|compléter)"
    r"|(?:beispiel|platzhalter|muster|blind)(?:text|inhalt|absatz)|hier (?:steht|kommt|folgt|erscheint)\b.{0,20}\b(?:ihr|dein|der|ein|eine)\b.{0,12}(?:text|titel|überschrift|inhalt|beschreibung)|(?:ihr|dein) text hier"
    r"|testo (?:di esempio|segnaposto|di prova|provvisorio)|(?:il )?(?:tuo|vostro|suo) testo (?:qui|va qui)|inserisci (?:qui )?il (?:tuo )?testo|(?:su|tu|aquí va su|aquí va tu) texto aquí|escriba aquí su texto|(?:o )?(?:seu|teu) texto aqui|insira (?:aqui )?o (?:seu )?texto",
    re.I,
)
#: Beyond doubt on a single source (masked text, so any number is 0).
ERROR = re.compile(
    # a status by its number or name
    r"\b(?:error|fehler|erreur|errore|erro)\s?:?\s?0\b|^0\b.{0,24}\b(?:error|not found|forbidden|fehler|erreur|errore|erro)\b|\bhttp(?: error| status)? 0\b|internal server error|bad gateway|gateway time-?out|service unavailable"
    # the page is missing
    r"|\b(?:page|file|url|address|link|content|resource|document|article|site)\b.{0,60}\b(?:not (?:be )?found|does ?n[o']t exist|no longer (?:exists?|available)|is broken)|(?:cannot|can't|could not|couldn't|unable to) (?:find|locate|load) (?:that|this|the|your) (?:page|file|url|address)|^(?:page |file )?not found\W*$"
    r"|\b(?:página|enlace|contenido|endereço|conteúdo)\b.{0,60}\bn(?:o|ão) (?:existe|(?:ha sido |foi )?encontrad)|\b(?:page|adresse)\b.{0,50}\b(?:introuvable|n'existe (?:pas|plus))|\b(?:seite|adresse)\b.{0,60}\b(?:nicht gefunden|existiert nicht)|\bpagina\b.{0,50}\bnon (?:è stata trovata|esiste)"
    # no admittance
    r"|\b(?:access|permission)(?: (?:is|was|has been))? (?:denied|forbidden)\b(?! to \w+ \w+ (?:at|in|because))|acceso (?:denegado|prohibido)|accès (?:refusé|interdit)|zugriff (?:verweigert|gesperrt)|accesso (?:negato|vietato)|acesso (?:negado|recusado)|(?:confirm|verify|prove) (?:that )?you(?:'re| are) (?:a )?(?:not a robot|human)|session has expired|(?:log|sign) ?in (?:again )?to continue"
    # out of order
    r"|(?:down|closed|offline) for (?:\w+ )?maintenance|under maintenance|(?:en|in|em) (?:mantenimiento|maintenance|manutenzione|manutenção)|wartungsarbeiten"
    # scripts are needed
    r"|\b(?:enable|activate|turn on|activez?|activer|aktivier\w*|attiva|ative|active)\b.{0,30}\bjava ?script\b|\b(?:needs?|requires?|without|ohne|sans|senza|sem|necesita) java ?script\b|\bjava ?script\b.{0,40}\b(?:enabled|disabled|required|deaktiviert|aktivieren|désactivé|desactivado)",
    re.I,
)

# Words that hint at an error or a demand for scripts; enough where a message recurs (fixed values).
_HINTS = frozenset(
    "error errors oops sorry denied forbidden refused expired unavailable maintenance server servers gateway timeout exception javascript script scripts scripting browser robot captcha reload refresh loading deleted broken undefined unexpected blocked session database connection "
    "fehler leider wartung wartungsarbeiten gesperrt verweigert anmelden erreichbar roboter erreur désolé introuvable indisponible refusé interdit connexion sentimos mantenimiento denegado prohibido inténtelo intentarlo "
    "errore spiacenti manutenzione riprova negato vietato erro lamentamos manutenção negado recusado".split()
)
_HINT_PHRASES = re.compile(r"\b(?:log|sign) ?in\b|\bnot (?:be )?found\b|\btry again\b|\bno longer\b|\bnothing (?:lives|here|behind|exists|to see)|\bpermission to\b|\bnicht (?:mehr )?gefunden|\bnichts mehr\b|\bn[o'](?: se ha| ha sido|est pas|existe)? ?(?:encontrad\w|existe|trouvée?)|\bnon (?:è stat\w )?(?:trovat\w|esiste)|\bnão (?:foi )?(?:encontrad\w|existe)|\bjá não\b|\bjust a moment\b")
_PHRASE_WORDS = frozenset("in login signin found again longer nothing to gefunden nichts encontrado encontrada encontrados existe trouvé trouvée n'existe trovata trovato esiste não já moment".split())
#: Words of which any match of ERROR holds one (beside those of _HINTS); looked for before the pattern.
_ERROR_WORDS = _HINTS | frozenset("http gefunden seite adresse pagina página enlace contenido endereço conteúdo found exist exists longer find locate load existe existiert encontrado encontrada encontrados n'existe trovata esiste expired continue human permission java aktiviert deaktiviert désactivé desactivado page file url address".split())
_EDIT_WORDS = frozenset("edit replace insert type write change remove delete fill describe customize customise add put goes ersetzen einfügen bearbeiten remplacer modifier sustituya sustitúyalo reemplace edite editar sostituisci modifica inserisci substitua insira steht ici hier aquí aqui qui".split())
_TEXT_WORDS = frozenset("text paragraph title heading image description content entry copy box section block words template texto texte testo inhalt contenu contenido conteúdo absatz überschrift titel titre título titolo".split())
_EDIT_OF_TEXT = re.compile(r"\b(?:%s)\b.*\b(?:%s)\b|\bgoes here\b" % ("|".join(sorted(_EDIT_WORDS)), "|".join(sorted(_TEXT_WORDS))))
_STATUS = re.compile(r"\W*(?:http )?[45]\d\d\W*")

# A sentence of a paragraph that names sample text is about it, unless it says so of itself.
_NAMED = re.compile(r"(?:sample|dummy|placeholder|filler|example|default|demo) |texto de |(?:texte|contenu|titre) (?:d|de |provisoire)|(?:beispiel|platzhalter|muster|blind)|testo (?:di |segna|provv)", re.I)
_SELF = re.compile(r"\W*(?:(?:this|here|i am|i'm|hier|dies\w*|das|ceci|ce|voici|est[eoa]|aquí|isto|aqui|quest[oa]|ecco)\b|[^.!?]{0,12}$)")
_QUOTED = re.compile(r"[\"“„«][^\"“”„«»]{1,200}[\"”“»]")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)*_]*\s+|(?<=[.!?][\"'”’»)*_])\s+")


def _parts(pattern: re.Pattern) -> tuple[str, ...]:
    """Literals of which any match of the pattern in a masked text holds at least one."""
    from re import _constants as C
    from re import _parser

    def of(items) -> set[str] | None:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is C.LITERAL and chr(arg) != "0":
                run += chr(arg).lower()
                continue
            if run:
                found.append({run})
            run, inner = "", None
            if op is C.SUBPATTERN:
                inner = of(arg[3])
            elif op is C.BRANCH:
                each = [of(b) for b in arg[1]]
                inner = None if None in each else set().union(*each)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
                inner = of(arg[2])
            if inner:
                found.append(inner)
        return max(found, key=lambda parts: min(map(len, parts)), default=None)

    parts = of(_parser.parse(pattern.pattern, pattern.flags)) or {""}
    return tuple(sorted(x for x in parts if not any(y != x and y in x for y in parts)))


_PROMPT_LITERALS, _ERROR_LITERALS = _parts(PROMPT), _parts(ERROR)
_DUMMY_PARTS = re.compile("bla|asdf|qwerty|foo bar|test test|dummy|lipsum|brown fox|lingues|word mountains")
_MARKED = re.compile(r"[{}<%\[#@|&$*(]|__|XXX")
_EDGES = ".,;:!?()[]{}\"'“”„«»…¡¿·/"


def without_code(text: str) -> str:
    if "```" in text:
        text = _FENCE.sub("\n", text)
    text = _INDENTED.sub("", text)
    return _CODE_SPAN.sub(" ", text) if "`" in text else text


def mask_word(word: str) -> str:
    """A word of a message: markup dropped, addresses as <u>, anything with a digit (numbers, dates, times, codes) as 0."""
    word = word.strip("*_#>").lower().replace("’", "'")
    if not word or word.isalpha():
        return word
    if "://" in word or word.startswith("www.") or ("@" in word and "." in word):
        return "<u>"
    if any(map(str.isdigit, word)):
        return "0" + (word[-1] if word[-1] in ".,;:!?" else "")
    return "" if word in "-+•–—" else word


class Messages:
    """Words masked and looked up, each word form once."""

    def __init__(self):
        self.known: dict[str, tuple[str, int]] = {}

    def _look_up(self, word: str) -> tuple[str, int]:
        masked = mask_word(word)
        bare = masked.strip(_EDGES)
        forms = {bare, *bare.replace("-", " ").split()}
        bits = sum(bit * (not forms.isdisjoint(words)) for bit, words in ((1, _HINTS), (2, _EDIT_WORDS), (4, _TEXT_WORDS), (8, _PHRASE_WORDS), (16, _ERROR_WORDS)))
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        self.known[word] = masked, bits
        return masked, bits

    def __call__(self, line: str) -> tuple[str, int]:
        """(masked line, bits of the word lists its words are in)."""
        get, look_up, out, bits = self.known.get, self._look_up, [], 0
        for w in line.split():
            masked, b = get(w) or look_up(w)
            if masked:
                out.append(masked)
                bits |= b
        return " ".join(out), bits


def mask(line: str) -> str:
    return Messages()(line)[0]


def is_filler(block: str) -> bool:
    low = block.lower()
    words = low.split()
    if LOREM.isdisjoint(words) and not _DUMMY_PARTS.search(low):
        return False
    words = _WORD.findall(low)
    return (len(words) >= FILLER_WORDS and sum(w in LOREM for w in words) >= FILLER_SHARE * len(words)) or (_DUMMY_PARTS.search(low) is not None and _DUMMY.search(block) is not None)


def _placeholder(text: str) -> bool:
    for m in PLACEHOLDER.finditer(text):
        if not _PLACEHOLDER_TAG.fullmatch(m[0]) or m[0].isupper():
            return True
    return False


def _holds(parts: tuple[str, ...], low: str) -> bool:
    return any(part in low for part in parts)


def prompts(sentence: str) -> bool:
    """Does a masked sentence of a paragraph prompt its editor, other than by quoting or naming such texts?"""
    unquoted = _QUOTED.sub(" ", sentence)
    return any(not _NAMED.match(m[0]) or _SELF.match(unquoted) for m in PROMPT.finditer(unquoted))


def _is_prompt(masked: str, prose: bool) -> bool:
    return _holds(_PROMPT_LITERALS, masked) and (prompts(masked) if prose else PROMPT.search(masked) is not None)


def examine(text: str, masked_line: Messages | None = None) -> tuple[str | None, list[tuple[str, bool, int, bool, int]], tuple[int, int]]:
    """(what the page shows whatever recurs, or None; messages as (masked text, heading, hint, beyond doubt an error, words); words of
    longer lines: in sentences beyond doubt an error, in others).

    hint: 1 error, 2 prompt, 3 both, 0 none.
    """
    masked_line = masked_line or Messages()
    text = without_code(text.replace("\r", ""))
    lines = text.split("\n")
    messages, sure, other, shown = [], 0, 0, None
    run: list[str] = []
    for line in [*lines, ""]:
        stripped = line.strip()
        if not stripped:
            if len(run) > 1 and is_filler(" ".join(run)):
                return "filler", [], (0, 0)
            run = []
            continue
        if _MARKED.search(stripped) and _placeholder(stripped):
            return "placeholder", [], (0, 0)
        heading = stripped[0] == "#" and re.match(r"#{1,6}\s", stripped) is not None
        if not heading:
            run.append(stripped)
        if is_filler(stripped):
            return "filler", [], (0, 0)
        masked, bits = masked_line(stripped)
        n = masked.count(" ") + 1 if masked else 0
        if n > MESSAGE_WORDS:
            for sentence in _SENTENCE.split(stripped) if bits & 22 else ():
                m, b = masked_line(sentence)
                if b & 6 and _is_prompt(m, True):
                    return "prompt", [], (0, 0)
                if b & 16 and ERROR.search(m):
                    k = m.count(" ") + 1
                    sure, other = sure + k, other - k
            other += n
        elif n:
            if bits & 6 and _is_prompt(masked, False):
                shown = "prompt"
            status = heading and _STATUS.fullmatch(stripped.lstrip("# ")) is not None
            hint = (1 if bits & 1 or status or (bits & 8 and _HINT_PHRASES.search(masked)) else 0) | (2 if bits & 2 and bits & 4 and not heading and _EDIT_OF_TEXT.search(masked) else 0)
            messages.append((masked, heading, hint, bool(bits & 16) and ERROR.search(masked) is not None, n))
    return (shown, messages, (sure, max(other, 0))) if not shown else (shown, [], (0, 0))


def residue(df: DataFrame, id_col: str, url_col: str, text_col: str, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """id, reason (placeholder, filler, prompt, error): one row per page that is a case."""
    pages = df.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(text_col).alias("text")).filter("text is not null")
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "site", "shown", "message", "heading", "hint", "sure", "words", "sure_words", "other_words", "open"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masked_line = Messages()
        for batch in batches:
            rows = []
            for i, host, text in zip(batch["id"], batch["host"], batch["text"]):
                shown, messages, (sure_words, other) = examine(text, masked_line)
                site = None if host is None else xxhash.xxh3_64_intdigest(host) - (1 << 63)
                # can the page be a case at all, whatever recurs?
                sign = sure_words > 0 or any(hint or sure for _, _, hint, sure, _ in messages)
                if shown or sign:
                    rows.append((i, site, shown, None, False, 0, False, 0, sure_words, other, sign))
                for masked, heading, hint, sure, n in messages:
                    rows.append((i, site, None, xxhash.xxh3_64_intdigest(masked) - (1 << 63), heading, hint, sure, n, 0, 0, sign))
            yield pd.DataFrame(rows, columns=names).astype({"message": "Int64", "site": "Int64"})

    schema = f"id {kind}, site long, shown string, message long, heading boolean, hint int, sure boolean, words int, sure_words int, other_words int, open boolean"
    rows = materialize(pages.mapInPandas(run, schema), "residue")
    shown = rows.filter("shown is not null").select("id", F.col("shown").alias("reason"))
    # sources per message: pairs first, so that a message that is everywhere is counted from one row per source
    spread = rows.filter("message is not null and site is not null").select("message", "site").distinct()
    recurring = spread.groupBy("message").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= min_hosts).select("message")
    salted = recurring.select("message", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("recurs"))
    of_open = rows.filter("open and shown is null").drop("site", "shown", "open").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    judged = of_open.join(salted, ["message", "salt"], "left").withColumn("recurs", F.coalesce("recurs", F.lit(False)))
    error = F.col("message").isNotNull() & F.when(F.col("recurs"), F.col("hint").bitwiseAND(1) > 0).otherwise(F.col("sure"))
    prompt = F.col("message").isNotNull() & F.col("recurs") & (F.col("hint").bitwiseAND(2) > 0)
    own = ~error & ~F.col("heading") & ~F.col("recurs")
    per_page = judged.groupBy("id").agg(
        F.max(prompt).alias("prompt"),
        F.max(error & F.col("heading")).alias("error_heading"),
        F.sum(F.when(error & ~F.col("heading"), F.col("words")).otherwise(F.col("sure_words"))).alias("error_words"),
        F.sum(F.when(own, F.col("words")).otherwise(0) + F.col("other_words")).alias("own_words"),
    )
    is_message = (F.col("error_words") > 0) & (F.col("own_words") <= F.greatest("error_words", F.lit(OTHER_WORDS)))
    bare = F.col("error_heading") & (F.col("own_words") == 0)
    messages = per_page.select("id", F.when(F.col("prompt"), "prompt").when(is_message | bare, "error").alias("reason")).filter("reason is not null")
    return shown.unionByName(messages).groupBy("id").agg(F.min("reason").alias("reason"))


def real_pages(df: DataFrame, id_col: str, url_col: str, text_col: str, **options) -> DataFrame:
    """df without the cases; rows with a null text or id stay."""
    cases = residue(df, id_col, url_col, text_col, **options).select(F.col("id").alias("__case"))
    return df.join(cases, F.col(id_col) == F.col("__case"), "left_anti")
