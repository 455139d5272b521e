"""Mail: bodies without quoted history and signatures, attachments worth keeping, files of raw mail."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime
from email.headerregistry import HeaderRegistry
from email.utils import parseaddr, parsedate_to_datetime
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_END, let, strip, strip_end, word_count

# Tags that are dropped with their content, tags that end a line, marks of quoted history.
DROPPED = frozenset(("script", "style", "head", "title", "noscript"))
ENDS_LINE = frozenset(("p", "div", "tr", "li", "h1", "h2", "h3", "h4"))
QUOTE_CLASSES = frozenset(("gmail_quote", "gmail_extra", "moz-cite-prefix", "OutlookMessageHeader"))
QUOTE_IDS = frozenset(("divRplyFwdMsg",))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
# Fixed value: styles that hide an element.
HIDDEN_STYLE = r"display\s*:\s*none|visibility\s*:\s*hidden|max-height\s*:\s*0"
# The lines that end a mail's own text, in German and English, one pattern for each sign.
SIGNATURE = "--"
MOBILE_SIGNATURE = r"(?iUd)^(Gesendet von meinem|Von meinem .* gesendet|Sent from my|Get Outlook for)\b"
QUOTED_MAIL = r"(?iUd)^-{2,}\s*(Urspr(ü|ue)ngliche Nachricht|Original Message|Weitergeleitete Nachricht|Forwarded message)\s*-{2,}"
QUOTE_INTRO = r"(?iUd)^(Am\s.+\sschrieb\s.+:|On\s.+\swrote:)\s*$"
HEADER_FIRST = r"(?iUd)^(Von|From)\s*:\s*.+"
HEADER_NEXT = r"(?iUd)^\s*(Gesendet|Sent|An|To|Datum|Date)\s*:\s*.+"
#: So many lines after a header's first one are searched for its next.
HEADER_LINES = 3
MIN_WORDS, MIN_IMAGE_BYTES, MIN_IMAGE_SIDE = 8, 20 * 1024, 200

_HIDDEN = re.compile(HIDDEN_STYLE, re.I)


class _Visible(HTMLParser):
    """Collects the text outside dropped, hidden and quoted elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[tuple[str, bool]] = []

    @property
    def silent(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br" and not self.silent:
            self.parts.append("\n")
        if tag in VOID:
            return
        has = dict(attrs)
        classes = set((has.get("class") or "").split())
        hides = tag in DROPPED or tag == "blockquote" or "hidden" in has or bool(_HIDDEN.search(has.get("style") or ""))
        self.open.append((tag, self.silent or hides or bool(classes & QUOTE_CLASSES) or has.get("id") in QUOTE_IDS))

    def handle_endtag(self, tag: str) -> None:
        places = [k for k, (t, _) in enumerate(self.open) if t == tag]
        if places:
            self._end(places[-1])

    def _end(self, place: int) -> None:
        """End the open elements from the innermost to the one at `place`."""
        while len(self.open) > place:
            tag, silent = self.open.pop()
            if tag in ENDS_LINE and not silent:
                self.parts.append("\n")

    def close(self) -> None:
        super().close()
        self._end(0)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def html_to_text(html: str) -> str:
    """The visible text: block ends and breaks are line ends."""
    parser = _Visible()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)


def _ends(line: Column, following: Column) -> Column:
    """Whether a line (stripped) is the first of a signature or of quoted mail; `following` are the lines after it.

    A header's first line counts only if the first filled line of those that follow is one of a header, too.
    """
    signs = line.rlike(MOBILE_SIGNATURE) | line.rlike(QUOTED_MAIL) | line.rlike(QUOTE_INTRO)
    return signs | (line.rlike(HEADER_FIRST) & following.rlike(HEADER_NEXT))


#: What any sign of a signature or quote has in it, in lower case. Most texts have none of it, and are looked at once as a whole.
_MAY_QUOTE = ("gesendet von meinem", "von meinem", "sent from my", "get outlook for", "--", "schrieb", "wrote:", ">")
_MAY_HEAD = r"(?U)(?:von|from)\s*:"
#: White space within a line, and ends of lines but the usual.
_BLANKS, _ODD_END = r"[ \t\x1f\p{Zs}]", r"\r\n|[\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"


def _may_quote(text: Column) -> Column:
    folded = F.lower(F.upper(text))
    found = folded.contains(":") & folded.rlike(_MAY_HEAD)
    for sign in _MAY_QUOTE:
        found = folded.contains(sign) | found
    return found | text.contains("\u0130")


def cut_quotes(text: Column) -> Column:
    """The text up to the first sign of a signature or quoted mail, without lines that quote, and without blanks at line ends."""
    plain = F.regexp_replace(F.regexp_replace(text, rf"{_BLANKS}++(?=(?:{LINE_END})|\z)", ""), _ODD_END, "\n")
    return F.when(_may_quote(text), _cut_lines(text)).otherwise(plain)


def _cut_lines(text: Column) -> Column:

    def own(lines: Column) -> Column:
        following = lambda i: F.array_join(F.slice(lines, i + 2, F.lit(HEADER_LINES)), "\n")
        ends = F.transform(lines, lambda x, i: (strip_end(x) == SIGNATURE) | let(strip(x), lambda line: _ends(line, following(i))))
        before = let(F.array_position(ends, True), lambda at: F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines))
        return F.filter(before, lambda x: ~strip(x).startswith(">"))

    return F.array_join(F.transform(let(F.split(text, LINE_END), own), strip_end), "\n")


def collapse_blank_lines(text: Column) -> Column:
    """No blanks before a line's end, one empty line at most between others, none at the ends. Indents stay."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def own_text(body: Column) -> Column:
    """A mail's own text from its plain body."""
    return collapse_blank_lines(cut_quotes(F.coalesce(body, F.lit(""))))


def visible_text(mails: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text): the visible text of HTML. Parsing is sequential in a text, so it's one Arrow call per batch."""
    narrow = mails.select(F.col(key).alias("key"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("key"), pa.array([html_to_text(x or "") for x in b.column("html").to_pylist()], pa.string())], ["key", "text"])

    out = narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, text string")
    return out.withColumnRenamed("key", key)


def clean_bodies(mails: DataFrame, key: str, body: str, html: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(key, text, n_words, has_substance) of mails whose bodies are plain text, or all of them HTML. Of plain ones columns to
    `keep` come along, so that mails needn't be read again to join them."""
    texts = visible_text(mails, key, body) if html else mails.select(key, *keep, F.col(body).alias("text"))
    cleaned = texts.select(key, *keep, own_text(F.col("text")).alias("text"))
    return cleaned.select(key, *keep, "text", word_count(F.col("text")).alias("n_words"), (word_count(F.col("text")) >= MIN_WORDS).alias("has_substance"))


def index_text(subject: Column, sender: Column, recipient: Column, date: Column, body: Column) -> Column:
    """What is indexed of a mail: its header lines, as far as they're filled, an empty line, the body."""
    lines = [F.when(v != "", F.concat(F.lit(f"{name}: "), v)) for name, v in (("Betreff", subject), ("Von", sender), ("An", recipient), ("Datum", date))]
    text = F.coalesce(body, F.lit(""))
    return strip(let(F.concat_ws("\n", *lines), lambda head: F.when(head == "", text).otherwise(F.concat(head, F.lit("\n\n"), text))))


def attachment_reasons(attachments: DataFrame, bodies: DataFrame, enabled: bool = True) -> DataFrame:
    """Attachments with `reason`: why one is dropped, or null. Only images are ever dropped.

    `attachments` has mail_id, content_type, content_id, inline, size, width, height; `bodies` has mail_id, html. An image is
    dropped that is shown inside the mail, is small in bytes, or, where its sides are known, small in pixels.
    """
    cids = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)cid:([^\"'\s>)]+)"), 1)
    shown = bodies.select("mail_id", cids.alias("_cids"))
    j = attachments.join(shown, "mail_id", "left")
    image = F.lower(F.trim(F.coalesce("content_type", F.lit("")))).startswith("image/")
    cid = F.regexp_replace(F.trim(F.coalesce("content_id", F.lit(""))), "^<|>$", "")
    inside = F.coalesce("inline", F.lit(False)) | ((cid != "") & F.coalesce(F.array_contains("_cids", cid), F.lit(False)))
    small = F.least("width", "height") < MIN_IMAGE_SIDE
    reason = F.when(F.lit(not enabled) | ~image, F.lit(None)).when(inside, "inline").when(F.col("size") < MIN_IMAGE_BYTES, "small").when(small, "small_side")
    return j.withColumn("reason", reason).drop("_cids")


EML = (
    "message_id string, subject string, sender string, sender_name string, recipient string, sent_at timestamp, "
    "plain string, html string, attachments array<struct<name string, content_type string, content_id string, inline boolean, content binary>>"
)


#: Values of headers that say what they say: the registry would take them apart and return them as they are.
_PLAIN = {
    "message-id": re.compile(r"<[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*>"),
    "subject": re.compile(r"[A-Za-z0-9.,:;!()/&-]+(?: [A-Za-z0-9.,:;!()/&-]+)*"),
}
#: Plain headers are as short as that at most, so that none is ever folded; others up to so many characters are remembered, the
#: last so many of them: mails that are read one after the other share most.
_UNFOLDED, _SHORT, _REMEMBERED = 60, 200, 4096
_registry = HeaderRegistry()
_remembered = lru_cache(_REMEMBERED)(_registry)


def _header(name: str, value: str) -> str:
    """A header as the standard policy has it. The policy itself takes a header apart each time that it's asked for."""
    plain = _PLAIN.get(name.lower())
    if plain and len(value) <= _UNFOLDED and plain.fullmatch(value):
        return value
    return _remembered(name, value) if len(value) <= _SHORT else _registry(name, value)


_POLICY = email.policy.default.clone(header_factory=_header)
#: Mails that are read before they are passed on.
_MAILS = 500


def parse_eml(content: bytes | None) -> dict | None:
    """Headers, bodies and attachments of a raw mail; a broken date is none, what can't be read at all is null."""
    try:
        mail = email.message_from_bytes(content or b"", policy=_POLICY)
        sender_name, sender = parseaddr(str(mail.get("From", "")))
        try:
            sent = parsedate_to_datetime(str(mail["Date"])) if mail["Date"] else None
        except (TypeError, ValueError):
            sent = None
        bodies: dict[str, str] = {}
        attachments = []
        for part in mail.walk():
            kind, name = part.get_content_type(), part.get_filename()
            if part.get_content_maintype() == "multipart":
                continue
            if kind in ("text/plain", "text/html") and not name and part.get_content_disposition() != "attachment":
                bodies.setdefault(kind, part.get_content())
            elif name or part.get_content_disposition() or part.get("Content-ID"):
                raw = part.get_payload(decode=True) if kind != "message/rfc822" else part.get_payload(0).as_bytes()
                attachments.append({"name": name or "", "content_type": kind, "content_id": str(part.get("Content-ID", "")).strip("<> "), "inline": part.get_content_disposition() == "inline", "content": raw or b""})
        return {
            "message_id": str(mail.get("Message-ID", "")).strip(), "subject": str(mail.get("Subject", "")), "sender": sender.lower(), "sender_name": sender_name,
            "recipient": parseaddr(str(mail.get("To", "")))[1].lower(), "sent_at": sent if isinstance(sent, datetime) else None,
            "plain": bodies.get("text/plain"), "html": bodies.get("text/html"), "attachments": attachments,
        }
    except (ValueError, LookupError, AttributeError, KeyError, IndexError):
        return None


def read_eml(files: DataFrame) -> DataFrame:
    """Mails from a table of files (path, content): path, sha256, and the fields of `parse_eml`, `ok` false where unreadable."""

    text, attachment = pa.string(), pa.struct([("name", pa.string()), ("content_type", pa.string()), ("content_id", pa.string()), ("inline", pa.bool_()), ("content", pa.binary())])
    kinds = dict.fromkeys(("message_id", "subject", "sender", "sender_name", "recipient"), text) | {"sent_at": pa.timestamp("us", "UTC"), "plain": text, "html": text, "attachments": pa.list_(attachment)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _MAILS):
                b = whole.slice(at, _MAILS)
                rows = [parse_eml(c.as_py()) for c in b.column("content")]
                columns = {n: pa.array([r and r[n] for r in rows], kind) for n, kind in kinds.items() if n != "sent_at"}
                columns["sent_at"] = pa.array([r and _utc(r["sent_at"]) for r in rows], kinds["sent_at"])
                ok = pa.array([r is not None for r in rows], pa.bool_())
                yield pa.record_batch([b.column("path"), b.column("sha256"), ok, *(columns[n] for n in kinds)], ["path", "sha256", "ok", *kinds])

    hashed = files.select("path", F.sha2("content", 256).alias("sha256"), "content")
    return hashed.mapInArrow(run, f"path string, sha256 string, ok boolean, {EML}")


def _utc(sent: datetime | None) -> datetime | None:
    """A time in UTC; one without a zone is in UTC already, one that leaves the calendar is none."""
    try:
        return sent and (sent.replace(tzinfo=UTC) if sent.tzinfo is None else sent.astimezone(UTC))
    except OverflowError:
        return None
