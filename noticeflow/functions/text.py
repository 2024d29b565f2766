"""Text functions as column expressions; folding sends rows beyond ASCII through a table pass."""

from __future__ import annotations

import html.entities
from functools import lru_cache

from pyspark.sql import Column, functions as F

from noticeflow.functions import folding
from noticeflow.lexicon import PORTUGUESE, Lexicon, TYPE_ALIASES

# Unicode white space plus the four ASCII separators.
WHITESPACE = r"[\p{IsWhite_Space}\x1c-\x1f]+"
NON_ASCII = r"[^\x00-\x7F]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(col: Column) -> Column:
    """Null becomes '', every white-space run one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), WHITESPACE, " "))


def casefold(col: Column) -> Column:
    """Full Unicode case folding."""
    return folding.by_table(col, "case", F.lower(col))


def squash_fold(col: Column) -> Column:
    text = F.coalesce(col, F.lit(""))
    return folding.by_table(text, "squash_case", F.lower(squash(col)), squash=True)


def normalize_title(col: Column) -> Column:
    return F.lower(squash(col))


def strip_marks(col: Column) -> Column:
    """Compatibility-decompose and drop combining marks."""
    return folding.by_table(col, "marks", col)


def fold_text(col: Column) -> Column:
    """Accent-free lower-case text with white space collapsed; null becomes ''."""
    text = F.coalesce(col, F.lit(""))
    return folding.by_table(text, "fold", squash(F.lower(text)), squash=True)


def fold_texts(col: Column) -> Column:
    """``fold_text`` of every element of an array of texts, none of them null."""
    return folding.lists_by_table(col, "fold", squash=True)


@lru_cache(maxsize=1)
def _entity_names() -> dict[str, dict[str, str]]:
    """HTML 5 names that end in a semicolon, by their first letter."""
    names: dict[str, dict[str, str]] = {}
    for name, value in html.entities.html5.items():
        if name.endswith(";"):
            names.setdefault(name[0], {})[name[:-1]] = value
    return names


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unescape_entities(col: Column) -> Column:
    """Replace named (HTML 5) and numeric character references.

    Numbers 128 to 159 are Windows-1252 characters, numbers that are no character U+FFFD.
    """
    inner = ", ".join(
        f"{_sql_text(first)}, map({', '.join(f'{_sql_text(n)}, {_sql_text(v)}' for n, v in sorted(own.items()))})"
        for first, own in sorted(_entity_names().items())
    )
    table = F.expr(f"map({inner})")
    controls = [bytes((c,)).decode("windows-1252", "replace") for c in range(128, 160)]

    def character(ref: Column) -> Column:
        # leading zeros are no digits; more than seven digits are beyond Unicode
        digits = F.regexp_extract(ref, "^#[xX]?0*([0-9A-Fa-f]*)$", 1)
        fits = F.length(digits) <= 7
        number = F.when(
            ref.rlike("^#[xX][0-9A-Fa-f]+$"), F.when(fits, F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("long")).otherwise(0)
        ).when(ref.rlike("^#[0-9]+$"), F.when(fits, F.concat(F.lit("0"), digits).cast("long")).otherwise(0))

        def spell(n: Column) -> Column:
            valid = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
            char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, n)), 8, "0")), "UTF-32")
            old = F.try_element_at(F.array(*map(F.lit, controls)), (n - 127).cast("int"))
            return F.when(n.between(128, 159), old).when(valid, char).when(n.isNotNull(), F.lit("\ufffd"))

        # The four commonest names skip the table.
        quick = F.when(ref == "amp", "&").when(ref == "quot", '"').when(ref == "lt", "<").when(ref == "gt", ">")
        named = F.try_element_at(F.try_element_at(table, F.substring(ref, 1, 1)), ref)
        return quick.when(ref.startswith("#"), let(number, spell)).otherwise(named)

    def piece(part: Column) -> Column:
        def swap(ref: Column) -> Column:
            rest = F.substr(part, F.length(ref) + 3)
            return F.when(ref == "", part).otherwise(F.coalesce(F.concat(character(ref), rest), part))

        return let(F.regexp_extract(part, r"^&(#?[0-9A-Za-z]+);", 1), swap)

    def decode(text: Column) -> Column:
        joined = F.array_join(F.transform(F.split(text, "(?=&)"), piece), "")
        return F.when(text.contains("&"), joined).otherwise(text)

    return let(col, decode)


def fix_mojibake(col: Column) -> Column:
    """Undo up to two rounds of UTF-8 text read as Latin-1."""

    def once(text: Column) -> Column:
        suspicious = text.contains("Ã") | text.contains("Â")
        # The guard sits inside the argument: encode() raises on unmappable characters.
        latin = F.when(suspicious & text.rlike(r"^[\x00-\xFF]*$"), text)
        reread = F.encode(latin, "ISO-8859-1").cast("string")
        return F.coalesce(F.when(F.is_valid_utf8(reread), reread), text)

    return F.when(col.contains("Ã") | col.contains("Â"), let(once(col), once)).otherwise(col)


# A tag ends outside quotes; with an unclosed quote, at the first >.
_MARKUP = (
    r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
    r"""|</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
    r"|</?[A-Za-z][^>]*>|<[!?][^>]*>"
)


def strip_markup(col: Column) -> Column:
    return unescape_entities(F.regexp_replace(col, _MARKUP, " "))


def clean_text(col: Column) -> Column:
    """Plain text: tags out when there are any, mojibake repaired, space collapsed."""
    text = F.coalesce(col, F.lit(""))
    has_markup = text.contains("<") & text.contains(">")
    plain = F.when(has_markup, strip_markup(text)).otherwise(text)
    return let(plain, lambda t: squash(fix_mojibake(t)))


def truncate(col: Column, limit: int) -> Column:
    """Null for empty; longer than ``limit`` is cut and marked with an ellipsis."""
    cut = F.concat(
        F.regexp_replace(F.substring(col, 1, limit - 3), WHITESPACE + "$", ""), F.lit("...")
    )
    return F.when(F.length(col) == 0, None).when(F.length(col) <= limit, col).otherwise(cut)


def audit_truncate(col: Column, limit: int = 180) -> Column:
    """Audit-report variant: cleans first and never yields null."""
    return F.coalesce(truncate(fix_mojibake(squash(col)), limit), F.lit(""))


def contains_any(col: Column, words) -> Column:
    """OR of substring tests: stays on UTF-8 bytes, no regex engine."""
    test = F.lit(False)
    for word in words:
        test = test | col.contains(word)
    return test


def has_keyword_folded(folded: Column, lexicon: Lexicon = PORTUGUESE) -> Column:
    test = contains_any(folded, lexicon.keywords)
    if lexicon.tender_pattern:
        test = test | folded.rlike(lexicon.tender_pattern)
    return test


def has_keyword(col: Column, lexicon: Lexicon = PORTUGUESE) -> Column:
    return has_keyword_folded(fold_text(col), lexicon)


def infer_notice_type_folded(folded: Column, lexicon: Lexicon = PORTUGUESE) -> Column:
    """First matching rule wins; a rule with a backslash is a pattern."""
    branches = F
    for fragment, kind in lexicon.type_rules:
        hit = folded.rlike(fragment) if "\\" in fragment else folded.contains(fragment)
        branches = branches.when(hit, F.lit(kind))
    return branches.otherwise(F.lit(lexicon.default_type))


def infer_notice_type(col: Column, lexicon: Lexicon = PORTUGUESE) -> Column:
    return infer_notice_type_folded(fold_text(col), lexicon)


def normalize_notice_type(col: Column) -> Column:
    """Known type for any accepted spelling, the default type for the rest."""
    key = F.translate(fold_text(col), "- ", "__")
    aliases = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, key), F.lit(PORTUGUESE.default_type))


def identity_token(col: Column) -> Column:
    """Letters and digits only, accent- and case-free."""
    text = F.coalesce(col, F.lit(""))
    return folding.by_table(text, "token", F.regexp_replace(F.lower(text), "[^a-z0-9]", ""))


def slug(col: Column, limit: int = 48, default: str = "source") -> Column:
    text = F.coalesce(col, F.lit(""))
    words = folding.by_table(text, "slug", F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), squash=True)
    text = F.translate(words, " ", "-")
    return F.coalesce(F.nullif(F.substring(text, 1, limit), F.lit("")), F.lit(default))


def stable_source_id(code: Column, name: Column, url: Column) -> Column:
    digest = F.substring(F.sha2(url, 256), 1, 10)
    return F.concat(F.lit("inep-"), code, F.lit("-"), slug(name), F.lit("-"), digest)


def html_escape(col: Column) -> Column:
    out = F.coalesce(col, F.lit(""))
    # The five escaped characters, ampersand first.
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


# Wording of the alert message.
_SUBJECT = "Novo Edital Encontrado: "
_NO_DESCRIPTION = "Sem descrição"
_BODY_LINES = (
    "<html>",
    "<body>",
    "<h2>Um novo edital que combina com seu alerta foi detectado!</h2>",
    "<p><strong>Título:</strong> {title}</p>",
    "<p><strong>Tipo:</strong> {type}</p>",
    "<p><strong>Descrição:</strong> {description}</p>",
    "<br>",
    '<p><a href="{url}">Clique aqui para acessar o edital oficial</a></p>',
    "</body>",
    "</html>",
)


def message_subject(title: Column) -> Column:
    return F.concat(F.lit(_SUBJECT), F.coalesce(title, F.lit("")))


def render_message(title: Column, kind: Column, description: Column, url: Column) -> Column:
    """HTML body of an alert message, every value escaped."""
    values = {
        "title": html_escape(title),
        "type": html_escape(kind),
        "description": html_escape(
            F.coalesce(F.nullif(description, F.lit("")), F.lit(_NO_DESCRIPTION))
        ),
        "url": html_escape(url),
    }
    parts = []
    for line in _BODY_LINES:
        for name, value in values.items():
            head, mark, tail = line.partition("{" + name + "}")
            if mark:
                parts.append(F.concat(F.lit(head), value, F.lit(tail)))
                break
        else:
            parts.append(F.lit(line))
    return F.concat_ws("\n", *parts)


def md_cell(col: Column) -> Column:
    """Markdown table cell: pipes escaped, line breaks flattened, null is ''."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
