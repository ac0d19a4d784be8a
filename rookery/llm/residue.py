"""Template residue, filler and error pages instead of content.

Quoted passages and code are blanked first: text that talks about such things is real. The rest is
cut into lines. Normalised lines are counted by host (distinct documents per line) and recurrent
ones are subtracted; the residual decides:

* a line that recurs is page furniture. Without evidence it is subtracted if it stands in
  recur_documents documents and a share recur_share of its host's. A line with evidence is
  subtracted only if it is site-wide (site_documents and site_share): a server gives one message
  on every page it fails on, so such lines recur without being furniture;
* an unfilled placeholder or filler text in a residual line excludes the document;
* an error message or a notice that scripts are required excludes it if hardly any other text
  remains (spare_chars), that is, if the message stands in place of content;
* evidence that was subtracted excludes it only if nothing else remains (bare_chars).

Placeholders are found by their syntax, filler by published filler texts, stock phrases and
repetition, messages by stock phrases of servers and browsers in some twenty languages. All that
is listed here is general; nothing was taken from a corpus.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.session import materialise

#: Distinct lines whose counts a task holds before it hands them on.
HELD_MARKS = 500_000

# Quoted passages and code, which are blanked.
QUOTED = re.compile(r"```(?s:.*?)(?:```|\Z)|`[^`\n]*`|\"[^\"\n]*\"|“[^“”\n]*”|„[^„“”\n]*[“”]|「[^「」\n]*」|《[^《》\n]*》")
#: A whole line that is an error object holds quotes itself; it becomes OBJECT_MARK first.
MESSAGE_OBJECT = re.compile(r"^[^\S\n]*\{\s*\"(?:error|status|message|code)\"[^\n]*\}[^\S\n]*$", re.M | re.I)
OBJECT_MARK = "\u0002"
LINE_ENDS = re.compile(r"[\n\r\u2028]+")
IDENTIFIER = re.compile(r"(?<![a-z0-9_-])[a-z_-]*+[0-9][a-z0-9_-]*+")
SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s*")

# Ways in which templates mark a value to be filled in. A NAME is one to four words.
_NAME = r"[^\W\d_][^\W_]*(?:[ _.\-][^\W_]+){0,3}"
PLACEHOLDERS = [
    rf"\{{\{{-?\s*{_NAME}(?:\s*\|[^{{}}\n]*)?\s*-?\}}\}}",
    rf"\$\{{\s*{_NAME}\s*\}}",
    rf"\{{%\s*{_NAME}\s*%\}}",
    rf"(?<![$\{{\w])\{{\s*{_NAME}\s*\}}(?!\}})",
    rf"%%\s*{_NAME}\s*%%",
    rf"%\({_NAME}\)[sdf]",
    rf"@@\s*{_NAME}\s*@@",
    rf"<%[=-]?\s*{_NAME}\s*-?%>",
    rf"<\?=?\s*{_NAME}\s*\?>",
    rf"\*\|\s*{_NAME}\s*\|\*",
    r"(?<![\w#])#[A-Z][A-Z_]{2,}#(?![\w#])",
    r"(?<!\w)__[A-Z][A-Z_]*[A-Z]__(?!\w)",
    r"«\s*[^\W\d_A-Z]+(?:[ _][^\W\d_A-Z]+){0,2}\s*»",
    r"(?i:\[(?:insert|enter|add|your|fill in|replace|type|choose|select|insertar|insérer|inserire|inserir|invoegen|infoga|wstaw)\b[^\]\n]{0,40}\])(?!\()",
    r"(?i:\[[^\]\n]{1,40}\b(?:einfügen|eintragen|einsetzen|here|hier|aquí|aqui|qui|ici|invullen|invoegen|här|tutaj)\])(?!\()",
    r"\[[A-Z]{3,}(?:[ _][A-Z]+){0,3}\](?!\()",
    r"(?i:<(?:insert|enter|your|add)\b[^<>\n]{1,40}>)",
    r"(?<![\w`])<(?!(?i:noscript|table|html|body|head|div|span|script|style|title|pre|code|form|font|center)>)[A-Z]{3,}(?:[ _][A-Z]+){0,3}>",
    r"(?<![\w`])<(?:[A-Z][a-z]+){2,4}>",
    r"(?<![\w`</])<(?!/|(?:a|b|i|p|u|s|br|hr|li|ul|ol|td|th|tr|em|h\d|div|img|nav|pre|sub|sup|svg|code|span|body|head|html|meta|main|form|input|table|thead|tbody|title|style|script|strong|button|footer|header|section|article|noscript|label|small|video|audio|iframe|int|float|string|double|bool|char|long|void|object)\b)[a-z]{3,}(?:[ _][a-z]+){0,3}>",
]

# The published filler texts, and the further words that filler generators draw from.
LOREM = """Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud
exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint
occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum"""
PERSPICIATIS = """Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi
architecto beatae vitae dicta sunt explicabo nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi
nesciunt neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat
voluptatem ut enim ad minima veniam quis nostrum exercitationem ullam corporis suscipit laboriosam nisi ut aliquid ex ea commodi consequatur at vero eos et accusamus et iusto odio dignissimos
ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident similique sunt in culpa qui officia
deserunt mollitia animi id est laborum et dolorum fuga et harum quidem rerum facilis est et expedita distinctio"""
GENERATED = """accumsan aenean aliquet auctor augue bibendum blandit condimentum congue conubia convallis cras curabitur cursus dapibus diam dictum dignissim donec efficitur egestas eget eleifend
elementum eros euismod facilisi faucibus felis fermentum feugiat finibus fringilla fusce gravida habitasse hendrerit iaculis imperdiet justo lacinia lacus laoreet lectus ligula lobortis luctus
maecenas magnis malesuada massa mattis mauris maximus metus morbi nascetur nibh nisl nullam nunc ornare parturient pellentesque pharetra phasellus placerat porta porttitor posuere pretium
pulvinar purus quisque rhoncus risus rutrum sagittis sapien scelerisque semper sodales sollicitudin suspendisse tellus tempus tincidunt tortor tristique turpis ultrices ultricies urna varius
vehicula venenatis vestibulum vivamus viverra volutpat vulputate"""
_FILLER_WORDS = frozenset(w for w in f"{LOREM} {PERSPICIATIS} {GENERATED}".lower().split() if len(w) > 3)
#: Beginnings of five letters and more count too: filler is often cut short.
_FILLER_FORMS = _FILLER_WORDS | {w[:n] for w in _FILLER_WORDS for n in range(5, len(w))}
#: Filler: so many such words within a window, of so many kinds.
FILLER_WINDOW, FILLER_HITS, FILLER_KINDS = 12, 4, 3
_LETTERS = re.compile(r"[^\W\d_]+")

FILLERS = [
    r"(?i:\blorem ipsum\b)",
    r"(?i:\b(?:sample|placeholder|dummy|example|filler|boilerplate)[- ](?:text|copy|paragraph|content|caption|heading|sentence)\b)",
    r"(?i:\b(?:text|copy|caption|heading|headline|title|content|description|image|paragraph|quote)s? (?:goes|go|comes|come) here\b)",
    r"(?i:\byour (?:heading|headline|title|text|content|caption|copy|tagline|name|logo|message|description) (?:goes )?here\b)",
    r"(?i:\b(?:content|text|copy|details|description) (?:to follow|coming soon|to come|will follow|to be added)\b)",
    r"(?i:\breplace (?:this |with )?(?:\w+ )?(?:text )?before publi(?:shing|cation)\b)",
    r"(?i:\bwrite (?:something|a few words|a sentence) about\b)",
    r"(?i:^\W*(?:add|enter|insert|type|write) (?:a |an |your |some )?(?:short |brief )?(?:description|text|caption|copy|title|content|summary|introduction|heading|headline)\b)",
    r"(?i:^\W*(?:todo|tbd|tba|tbc|fixme)(?:\W+(?:todo|tbd|tba|tbc|fixme|add|write|fill|insert|copy|text|content|this|here|in|section|caption|description))*\W*$)",
    r"(?i:\basdf(?:\s|\b)|\bqwer(?:ty)?\s+asdf\b)",
    r"(?i:\bblah(?:\W+blah)+\b)",
    r"(?i:^\W*test(?:\s+(?:test|\d+))+\W*$)",
    r"(?i:\bbody text\s*body text\b)",
    r"(?i:\bfoo bar(?: baz)?\b)",
    r"(?i:\btexto (?:de ejemplo|de relleno|de prueba|de muestra|simulado|de exemplo|de preenchimento)\b)",
    r"(?i:\bhier (?:steht|kommt|folgt|entsteht) (?:später |noch |bald )?(?:ein |der |dein |ihr )?(?:text|inhalt)\b|\b(?:blind|platzhalter|beispiel|muster)text\b)",
    r"(?i:\btexte? (?:d'exemple|de remplissage|factice|fictif|à venir)\b|\bfaux[- ]texte\b|\bvotre texte ici\b)",
    r"(?i:\b(?:voorbeeld|opvul|vul)tekst\b|\bhier komt (?:later )?(?:een |de )?tekst\b|\btesto (?:di esempio|segnaposto|di prova)\b|\binserisci (?:qui )?il testo\b)",
    r"(?i:\b(?:exempel|utfyllnads|platshållar|eksempel|udfyldnings|pladsholder|utfyllings)te[kx]st\b|\b(?:przykładowy|zastępczy) tekst\b|\btekst (?:przykładowy|zastępczy)\b|\btu wpisz tekst\b)",
    r"(?i:\b(?:ukázkový|zástupný|vzorový) text\b|\bmalliteksti|\bpaikkamerkkiteksti|\b(?:örnek|yer tutucu) metin\b)",
    r"ここに.{0,8}(?:入ります|入力|挿入)|ダミーテキスト|サンプル(?:テキスト|文章)|此处(?:填写|输入|插入)|在此(?:填写|输入|插入)|示例文(?:本|字)|占位(?:文本|符)|여기에.{0,10}(?:입력|텍스트)|예시 텍스트",
    r"(?i:\bздесь (?:будет|должен быть) текст\b|\b(?:пример|образец) текста\b|\bтекст[- ]заполнитель\b|\bтут буде текст\b)",
]

# Messages that stand where content should be, of servers, browsers and runtimes.
ERRORS = [
    r"\b(?:error|erreur|fehler|fout|errore|erro|fel|feil|fejl|błąd|chyba|virhe|hata|ошибка|помилка)\W{0,2}(?:code\W{0,2})?[45]\d\d\b\s*(?:[:)\-–—]|$)",
    r"(?:エラー|错误|錯誤|오류)\W{0,2}[45]\d\d",
    r"\b[45]\d\d\b\W{0,3}(?:not found|forbidden|bad gateway|internal server error|service unavailable|gateway time-?out|unauthorized|bad request|method not allowed|gone|request time-?out)",
    r"\bpage\b.{0,40}\b(?:not be found|not found|no longer exists|no longer available|was moved|has moved|has been removed|does not exist|doesn't exist|not available|is missing)",
    r"\b(?:can't|cannot|couldn't|could not) find (?:the|that|this) page\b",
    r"seite (?:wurde |konnte )?nicht gefunden|seite existiert nicht|page (?:est )?introuvable|page (?:n'existe|non trouvée|n'a pas été trouvée)|página no (?:encontrada|existe|se encuentra)|página não (?:foi )?(?:encontrada|existe)|pagina non (?:è stata )?(?:trovata|esiste)",
    r"deze pagina bestaat niet|pagina (?:is )?niet gevonden|sidan (?:kunde inte hittas|hittades inte|finns inte)|siden (?:blev ikke fundet|ble ikke funnet|findes ikke|finnes ikke|eksisterer ikke)|sivua ei (?:löytynyt|löydy)",
    r"nie znaleziono strony|strona nie (?:istnieje|została znaleziona)|stránka (?:nebyla nalezena|neexistuje|nenalezena)|sayfa bulunamadı|страница не (?:найдена|существует)|сторінк[уа] не знайдено",
    r"ページが見つかりません|お探しのページ|ページは存在しません|页面不存在|找不到(?:该|此)?页面|頁面不存在|找不到(?:該|此)?頁面|페이지를 찾을 수 없|アクセスが拒否|访问被拒绝|접근이 거부",
    r"erreur interne|interner (?:server)?fehler|error interno|interne (?:server)?fout|errore interno|erro interno|internt (?:server)?fel|intern (?:server)?feil|intern (?:server)?fejl|wewnętrzny błąd|błąd wewnętrzny|vnitřní chyba|sunucu hatası|внутренняя ошибка",
    r"\baccess (?:is |was )?denied\b|\bpermission denied\b|\bdo(?:es)? not have permission\b|\bzugriff verweigert|\baccès refusé|\bacceso denegado|\bacesso negado|\btoegang geweigerd|\baccesso negato|\båtkomst nekad|\badgang nægtet|\bingen tilgang|\bodmowa dostępu|\bbrak dostępu|\bpřístup odepřen|\berişim engellendi|доступ запрещ[её]н",
    r"\bsession (?:has |is )?(?:expired|timed out)|\bsitzung (?:ist )?abgelaufen|\bsesión (?:ha )?(?:expirado|caducado)|\bsession (?:a )?expirée?|\bsessão expirou|\bsessione scaduta|\bsessie (?:is )?verlopen|\bsessionen har gått ut|\bsesja wygasła",
    r"\bsomething went wrong\b|\ban error (?:has )?occurred\b|\bunexpected (?:condition|error)\b|\binternal (?:server )?error\b|\bapplication error\b",
    r"\bein (?:unerwarteter )?fehler ist aufgetreten|\bune erreur (?:est survenue|s'est produite)|\bse ha producido un error|\bha ocurrido un error|\bsi è verificato un errore|\bocorreu um erro|\ber is (?:iets misgegaan|een fout opgetreden)|\bett fel (?:uppstod|har inträffat)|\bder opstod en fejl|\bdet oppstod en feil|\bwystąpił błąd|\bпроизошла ошибка|エラーが発生しました|发生错误|오류가 발생",
    r"\btoo many requests\b|\brate limit (?:exceeded|reached)|\bquota exceeded\b",
    r"\bdown for (?:\w+ )?maintenance\b|\bunder maintenance\b|wartungsarbeiten|en mantenimiento|em manutenção|en maintenance|in manutenzione|in onderhoud|under underhåll|prace konserwacyjne|bakımda|техническ\w+ работ|メンテナンス中|维护中|점검 중",
    r"\b(?:could not|cannot|can't|unable to|failed to) connect to\b|\bupstream (?:server|timeout|connect error)|\bbad gateway\b|\bgateway time-?out\b|\bservice (?:is )?(?:temporarily |currently )?unavailable\b|\btemporarily unavailable\b",
    r"\brequest could not be (?:satisfied|processed|completed)\b|\brequested (?:url|page|resource) (?:was|is|has been) (?:rejected|blocked|unavailable)\b|\bserver did not (?:answer|respond)|\bconnection (?:was )?(?:refused|timed out|reset)|\bthis site can(?:'t|not) be reached\b|\bverify (?:that )?you are (?:a )?human\b",
    r"^\W*traceback \(most recent call last\)|^\W*file\b.{0,80}\bline \d+|^\s*at [\w.$<>]+\([\w. ]+:?\d*\)|^\W*(?:[a-z_]\w*\.)*[a-z]\w*(?:error|exception)\b(?::.{0,80})?$",
]
_ON = "enable|activate|turn on|allow|switch on|require|requires|needs?"
SCRIPTS = [
    rf"\b(?:{_ON}|with)\b.{{0,30}}\b(?:java)?scripts?\b",
    r"\bjavascript\b.{0,40}\b(?:disabled|required|enabled|turned off|only|blocked|inschakelen|erforderlich|benötigt|deaktiviert|requis|nécessaire|désactivé|necesario|desactivado|necessário|desativado|richiesto|disabilitato|vereist|uitgeschakeld|krävs|inaktiverat|kræves|kreves|wymagany|wyłączony|wyłączona|vyžadován|gerekli|gerekiyor)",
    r"\b(?:aktivieren|activar|activez|activer|active|activa|habilite|habilita|habilitar|schakel|abilit\w+|attiva\w*|ative|aktivera|aktiver|slå på|włącz|povolte|zapněte|etkinleştirin|включите|увімкніть)\b.{0,30}javascript",
    r"javascript.{0,12}(?:有効|無効|启用|啟用|開啟|활성화|required)|(?:有効|启用|請啟用|请启用).{0,12}javascript",
    r"<noscript\b|\bbrowser does not support\b|\bchecking your browser\b|\bscripts?\b.{0,40}\b(?:must be (?:on|enabled|allowed)|blocked|blocks|disabled|switched off)\b",
    r"^\W*loading\W*$",
]
#: Lines that are wholly part of a stack trace; the full stops in them end no sentence.
TRACE_LINE = re.compile(r"(?i:^\W*file\b.{0,80}\bline \d+(?:,? in \S+)?\s*$|^\s*at [\w.$<>]+\([\w. ]+:?\d*\)\s*$|^\W*(?:[a-z_]\w*\.)*[a-z]\w*(?:error|exception)\b(?::.{0,80})?$)")
_KINDS = ((1, PLACEHOLDERS), (2, FILLERS), (4, [OBJECT_MARK, *(f"(?i:{p})" for p in ERRORS + SCRIPTS)]))
_LATIN_BIT = 1


def fold(text: str) -> str:
    """Lower case, the letters that patterns without case take for i and s included."""
    low = text.lower()
    return low if low.isascii() else low.replace("i\u0307", "i").replace("ı", "i").replace("ſ", "s")


def factors(pattern: str) -> frozenset[str] | None:
    """Folded literals of which every match of the pattern holds at least one, read off its parse
    tree; None if it has none. The longest least literal wins."""
    from re import _parser

    def better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
        if a is None or b is None:
            return a or b
        return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))

    def needed(parts) -> frozenset[str] | None:
        best, run = None, ""
        for op, arg in [*parts, ("END", None)]:
            name = str(op)
            if name == "LITERAL":
                run += fold(chr(arg))
                continue
            if name in ("AT", "ASSERT", "ASSERT_NOT"):
                continue  # they take no room
            best, run = better(best, frozenset([run]) if run else None), ""
            if name == "SUBPATTERN":
                best = better(best, needed(arg[3]))
            elif name == "BRANCH":
                each = [needed(branch) for branch in arg[1]]
                best = better(best, None if None in each else frozenset().union(*each))
            elif name.endswith("REPEAT") and arg[0]:
                best = better(best, needed(arg[2]))
        return best

    return needed(_parser.parse(pattern))


class Finder:
    """All patterns, and an automaton of their factors that tells which can match a line at all."""

    def __init__(self) -> None:
        import ahocorasick

        self.kind, self.patterns, self.always = [2], [None], 0  # place 0: published filler
        self.machine = ahocorasick.Automaton()
        self._sign(_FILLER_WORDS, _LATIN_BIT)
        self._sign({w[:5] for w in _FILLER_WORDS if len(w) > 5}, _LATIN_BIT)
        for kind, patterns in _KINDS:
            for pattern in patterns:
                bit = 1 << len(self.patterns)
                self.patterns.append(re.compile(pattern))
                self.kind.append(kind)
                found = factors(pattern)
                if found is None:
                    self.always |= bit
                else:
                    self._sign(found, bit)
        self.machine.make_automaton()

    def _sign(self, words, bit: int) -> None:
        for word in words:
            self.machine.add_word(word, self.machine.get(word, 0) | bit)

    def signs(self, text: str) -> int:
        """A bit for every pattern that may match text."""
        found = self.always
        for _, bits in self.machine.iter(fold(text)):
            found |= bits
        return found

    def kinds(self, line: str, signs: int) -> int:
        """1 placeholder, 2 filler, 4 message, added up; only the signed patterns are tried."""
        out = 0
        while signs:
            place = (signs & -signs).bit_length() - 1
            signs &= signs - 1
            if not out & self.kind[place] and (published_filler(line) if not place else self.patterns[place].search(line)):
                out |= self.kind[place]
        return out

    def spare(self, line: str, kinds: int, signs: int) -> int:
        """Characters of a line beside the message in it."""
        if not kinds & 4:
            return len(line.strip())
        if TRACE_LINE.search(line):
            return 0
        messages = signs & self.message_bits
        return sum(len(part.strip()) for part in SENTENCE_END.split(line) if not self.kinds(part, messages) & 4)

    @functools.cached_property
    def message_bits(self) -> int:
        return sum(1 << i for i, kind in enumerate(self.kind) if kind == 4)


@functools.lru_cache(maxsize=1)
def finder() -> Finder:
    return Finder()


def published_filler(line: str) -> bool:
    """Whether some window of words draws on the published filler texts: FILLER_HITS of
    FILLER_WINDOW words of more than three letters, FILLER_KINDS different ones among them."""
    words = [w for w in _LETTERS.findall(fold(line)) if len(w) > 3]
    hits = [i for i, w in enumerate(words) if w in _FILLER_FORMS]
    for a, b in zip(hits, hits[FILLER_HITS - 1 :]):
        if b - a < FILLER_WINDOW and len({words[i] for i in hits if a <= i < a + FILLER_WINDOW}) >= FILLER_KINDS:
            return True
    return False


def signs_in(text: str) -> int:
    """1 if text may hold a placeholder, 2 filler, 4 a message, added up."""
    f = finder()
    signs, out = f.signs(text), 0
    for place, kind in enumerate(f.kind):
        if signs >> place & 1:
            out |= kind
    return out


def blanked(text: str) -> str:
    """The text with quotes and code blanked and error objects marked."""
    return QUOTED.sub(" \u0001 ", MESSAGE_OBJECT.sub(OBJECT_MARK, text))


def normalised_lines(lines: list[str]) -> list[str]:
    """Lower case, numbers and identifiers (ASCII letters and digits with - or _) as 0, white
    space collapsed; blank lines are empty strings."""
    return [" ".join(line.split()) for line in IDENTIFIER.sub("0", "\n".join(lines).lower()).split("\n")]


def mark(host: str, line: str) -> int:
    """Identifies host and normalised line; the empty line stands for the host itself."""
    return xxhash.xxh3_64_intdigest(f"{host}\0{line}".encode(errors="surrogatepass")) - (1 << 63)


_FACTS = "host long, mark long, documents long, kinds int, spare long"


def _facts(docs: DataFrame) -> DataFrame:
    """Of (id, host, text), in one pass: (mark, documents), how many documents hold each line,
    added up within a task, and for every document with evidence its distinct non-blank lines as
    (id, host, mark, kinds, spare), host being the mark of the host itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder()
        seen: Counter[int] = Counter()
        names = ["id", "host", "mark", "documents", "kinds", "spare"]
        id_type = None

        def counted() -> pa.RecordBatch:
            n = len(seen)
            nothing = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(n, id_type), nothing, pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64()), pa.nulls(n, pa.int32()), nothing], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            rows, hosts, marks, kinds, spares = [], [], [], [], []
            for r, (host, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                lines = [line for line in dict.fromkeys(LINE_ENDS.split(blanked(text))) if line.strip()]
                whole = mark(host, "")
                places = [mark(host, line) for line in normalised_lines(lines)]
                seen.update({whole, *places})
                if not f.signs(text) and '"' not in text:  # an error object has quotes
                    continue
                signs = [f.signs(line) for line in lines]
                held = [f.kinds(line, s) for line, s in zip(lines, signs)]
                if any(held):
                    for line, s, place, k in zip(lines, signs, places, held):
                        rows.append(r), hosts.append(whole), marks.append(place), kinds.append(k), spares.append(f.spare(line, k, s))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hosts, pa.int64()), pa.array(marks, pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array(kinds, pa.int32()), pa.array(spares, pa.int64())], names=names
                )
            if len(seen) >= HELD_MARKS:
                yield counted()
                seen.clear()
        if seen:
            yield counted()

    return docs.select("id", "host", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, {_FACTS}")


def residue(df: DataFrame, key: str, text: str, host: str, recur_documents: int = 3, recur_share: float = 0.0005, site_documents: int = 10, site_share: float = 0.1) -> DataFrame:
    """(id, placeholders, fillers, messages, furniture, spare): documents with evidence outside quotes
    and code: the residual lines with placeholders, fillers and messages (errors and script
    notices), the site-wide lines with any of these, and the characters of residual text that is
    none of them. See without_content for the verdict.

    Null and blank texts have no evidence; nulls are a host of their own; rows of equal keys are
    taken together; other columns are ignored; an empty table gives no rows.
    """
    docs = df.select(F.col(key).alias("id"), F.lower(F.trim(F.coalesce(F.col(host).cast("string"), F.lit("")))).alias("host"), F.col(text).alias("text")).where("text is not null")
    facts = materialise(_facts(docs))
    told = facts.where("documents is null").select("id", "host", "mark", "kinds", "spare")
    wanted = told.select("mark").union(told.select("host")).distinct()
    counts = facts.where("documents is not null").groupBy("mark").agg(F.sum("documents").alias("documents")).where(f"documents >= {min(recur_documents, site_documents)}").join(wanted, "mark", "left_semi")
    held = counts.select(F.col("mark").alias("host"), F.col("documents").alias("held"))
    lines = told.join(counts, "mark", "left").join(held, "host", "left")
    recurs = f"coalesce(documents >= {recur_documents} and documents >= {recur_share!r} * held, false)"
    site_wide = f"coalesce(documents >= {site_documents} and documents >= {site_share!r} * held, false)"
    lines = lines.selectExpr("id", "kinds", "spare", f"if(kinds = 0, {recurs}, {site_wide}) as furniture")
    residual = lambda bit: F.count_if(F.expr(f"kinds & {bit} > 0 and not furniture"))
    return lines.groupBy("id").agg(
        residual(1).alias("placeholders"), residual(2).alias("fillers"), residual(4).alias("messages"), F.count_if(F.expr("kinds > 0 and furniture")).alias("furniture"), F.sum(F.when(~F.col("furniture"), F.col("spare")).otherwise(0)).alias("spare")
    )


def without_content(found: DataFrame, spare_chars: int = 120, bare_chars: int = 20) -> DataFrame:
    """(id, reason): documents of residue() to be left out: 'placeholder', 'filler', 'message', or
    'furniture' where nothing is left but site-wide lines that are evidence."""
    message = (F.col("messages") > 0) & (F.col("spare") <= spare_chars)
    bare = (F.col("furniture") > 0) & (F.col("spare") <= bare_chars)
    verdict = F.when(F.col("placeholders") > 0, "placeholder").when(F.col("fillers") > 0, "filler").when(message, "message").when(bare, "furniture")
    return found.select("id", verdict.alias("reason")).where("reason is not null")
