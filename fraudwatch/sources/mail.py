"""Raw mails to message rows.

Spark hands mails to the workers in Arrow batches of bounded bytes
(``spark.sql.execution.arrow.maxBytesPerBatch``), so large mails do not pile up.
"""

import base64
import binascii
import codecs
import re
import sys
from collections.abc import Iterator
from email import message_from_bytes
from email.message import Message
from quopri import decodestring

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from fraudwatch import schemas
from fraudwatch.functions.text import mail_time

# The parser travels with the job: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARSED = T.StructType(schemas.MESSAGE.fields + [T.StructField("error", T.StringType())])

#: =?charset?B or Q?text?=, and the white space that only parts two of them.
WORD = re.compile(r"=\?([^?\s]+)\?([bqBQ])\?([^?]*)\?=")
RUN = re.compile(rf"(?:{WORD.pattern})+")
BETWEEN = re.compile(r"(\?=)\s+(?==\?[^?\s]+\?[bqBQ]\?)")


def known_charset(name: str | None) -> str | None:
    try:
        return codecs.lookup((name or "utf-8").partition("*")[0]).name
    except LookupError:
        return None


def _word(found: re.Match) -> tuple[str | None, bytes]:
    """Charset and bytes of an encoded word; no charset if it cannot be decoded."""
    try:
        if found[2] in "bB":
            raw = base64.b64decode(found[3] + "=" * (-len(found[3]) % 4))
        else:
            raw = decodestring(found[3].replace("_", " ").encode("latin-1"), header=True)
    except (binascii.Error, UnicodeEncodeError):
        return None, b""
    return known_charset(found[1]), raw


def unfolded(header: object) -> str:
    """A header's words as text (RFC 2047); a word that cannot be decoded stays as it is, bad bytes go.

    Neighbouring words of one charset are decoded as one, since a character may be
    split between them.
    """

    def run(found: re.Match) -> str:
        out: list[tuple[str | None, bytes | str]] = []
        for word in WORD.finditer(found[0]):
            charset, raw = _word(word)
            if charset and out and out[-1][0] == charset:
                out[-1] = charset, out[-1][1] + raw
            else:
                out.append((charset, raw if charset else word[0]))
        return "".join(told.decode(charset, "ignore") if charset else told for charset, told in out)

    plain = str(header or "").encode("utf-8", "ignore").decode()
    return RUN.sub(run, BETWEEN.sub(r"\1", plain))


def readable(message: Message) -> Iterator[tuple[str, str]]:
    """(type, text) of each part, in order, that is shown in place and has bytes in a known charset."""
    for part in message.walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment":
            continue
        raw, charset = part.get_payload(decode=True), known_charset(part.get_content_charset())
        if raw and charset:
            yield part.get_content_type(), raw.decode(charset, "ignore")


def body_of(message: Message) -> str:
    """The first plain part, or if it is blank or missing the last HTML part before it.

    A mail of a single part is its text, whatever its type, also as an attachment.
    """
    if not message.is_multipart():
        del message["Content-Disposition"]
        return next((text for _, text in readable(message)), "")
    shown = list(readable(message))
    kinds = [kind for kind, _ in shown]
    end = kinds.index("text/plain") if "text/plain" in kinds else len(shown)
    plain = [text for _, text in shown[end : end + 1] if text.strip()]
    return (plain or [text for kind, text in shown[:end] if kind == "text/html"] or [""])[-1]


def message_row(raw: bytes | None) -> dict:
    """The message columns of one mail, or the error that kept it from being read."""
    try:
        message = message_from_bytes(bytes(raw))
        date = message["Date"]
        return {
            "from": unfolded(message["From"]), "subject": unfolded(message["Subject"]), "body": body_of(message),
            "date": None if date is None else str(date), "error": None,
        }
    except Exception as error:  # whatever is wrong with one mail, the others are read
        return dict.fromkeys(("from", "subject", "body", "date")) | {"error": f"{type(error).__name__}: {error}"}


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["from", "subject", "body", "date", "error"]
    for batch in batches:
        rows = pd.DataFrame([message_row(raw) for raw in batch["raw"]], columns=columns, index=batch.index)
        yield batch[["uid", "mailbox"]].join(rows)[PARSED.names]


def content_keyed(raw_mails: DataFrame) -> DataFrame:
    """Give each mail a key that a later delivery of the same mail shares."""
    return raw_mails.withColumn("uid", F.sha2("raw", 256))


def timed(messages: DataFrame) -> DataFrame:
    return messages.withColumn("sent_at", mail_time(F.col("date")))


def parse_mail(raw_mails: DataFrame) -> DataFrame:
    """``(uid, mailbox, raw)`` to messages; a mail that cannot be read keeps its error."""
    return raw_mails.select("uid", "mailbox", "raw").mapInPandas(_parse_batches, PARSED)
