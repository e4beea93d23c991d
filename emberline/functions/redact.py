"""Command-line redaction.

The rule is a left-to-right walk: a redacted argument is never looked at again.
One regular-expression replacement walks the same way, because a match consumes
the flag together with the value it hides. Arguments are joined with NUL, which
no argument can contain, so blanks inside arguments are safe.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.basics import as_col, bind

# Flags whose next argument is always hidden, whole-word names,
# name endings, and the replacement text.
STRICT_FLAGS = (
    "--password", "--token", "--api-key", "--apikey", "--secret",
    "--client-secret", "--access-token", "--auth-token", "--session-id",
)
WHOLE_NAMES = ("password", "token", "secret", "key", "auth")
BOUNDED_ENDINGS = ("password", "token", "secret", "signature", "credential", "cookie", "session")
KEY_ENDINGS = ("_key", "-key", ".key")
LOOSE_FLAGS = STRICT_FLAGS[:-1]
LOOSE_ENDINGS = ("password", "token", "secret", "_key")
REDACTED = "[REDACTED]"

_STRICT = "(?:" + "|".join(STRICT_FLAGS) + ")"
_LOOSE = "(?:" + "|".join(LOOSE_FLAGS) + ")"
_BOUNDED = "(?:" + "|".join(BOUNDED_ENDINGS) + ")"
_WHOLE = "(?:" + "|".join(WHOLE_NAMES) + ")"


def _name(char: str) -> str:
    """A sensitive name built from characters of class ``char``."""
    return rf"-*(?:{_WHOLE}|(?:{char}*[-_.])?{_BOUNDED}|{char}*[-_.]key)"


# A match begins at the start of an argument and leaves the separator after the
# hidden value in place, so that the next argument can begin a match of its own.
STRICT_RULE = (
    rf"(?i)((?:^|\x00)(?:{_name('[^\\x00=]')}=|{_STRICT}=|{_STRICT}\x00"
    rf"|{_name('[^\\x00=]')}\x00(?!-)))[^\x00]*"
)
LOOSE_RULE = (
    rf"((?:^|\x00)(?:-*(?i:[^\x00=]*(?:{'|'.join(LOOSE_ENDINGS)})|{_WHOLE})="
    rf"|{_LOOSE}=|{_LOOSE}\x00))[^\x00]*"
)
# Every rule needs one of these words, so most command lines are done after one scan.
ANY_NAME = "(?i)key|auth|" + "|".join(BOUNDED_ENDINGS)
SENSITIVE_KEY = rf"(?i)^(?:{_WHOLE}|(?:.*[-_.])?{_BOUNDED}|.*[-_.]key)$"


def is_sensitive_key(name) -> Column:
    """Whether a name (without leading dashes) marks a secret."""
    return as_col(name).rlike(SENSITIVE_KEY)


def sanitize_command(args, mode: str = "strict") -> Column:
    """Join an ``ARRAY<STRING>`` of arguments with blanks, secrets replaced.

    ``strict`` knows name boundaries and hides the value after a heuristic name;
    ``loose`` takes bare endings and only hides after the fixed flags.
    """
    rule = {"strict": STRICT_RULE, "loose": LOOSE_RULE}[mode]

    def hide(joined: Column) -> Column:
        hidden = F.regexp_replace(joined, rule, "$1" + REDACTED)
        return F.translate(F.when(joined.rlike(ANY_NAME), hidden).otherwise(joined), "\x00", " ")

    return bind(F.array_join(as_col(args), "\x00"), hide)


def split_words(text) -> Column:
    """Text cut at white space, without empty pieces."""
    return F.filter(F.split(as_col(text), r"[\s\x0b\x85\xa0]+"), lambda w: w != "")
