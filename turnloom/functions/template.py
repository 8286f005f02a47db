"""Chat templates as data, rendered by built-in array and string functions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


_BLANKS = " \t\n\v\f\r"


@dataclass(frozen=True)
class ChatTemplate:
    """Text around each message. ``{role}`` in a marker stands for the role.

    ``markers`` overrides prefix and suffix for single roles. Whatever the
    template refuses to render is found by predicates, never by catching errors.
    """

    prefix: str = "<|{role}|>\n"
    suffix: str = "\n<|end|>\n"
    generation: str = "<|assistant|>\n"
    markers: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    strict_alternation: bool = False

    def _around(self, prefix: str, suffix: str, m: Column) -> Column:
        parts: list[Column] = []
        for marker, tail in ((prefix, m["content"]), (suffix, None)):
            for i, piece in enumerate(marker.split("{role}")):
                if i:
                    parts.append(m["role"])
                if piece:
                    parts.append(F.lit(piece))
            if tail is not None:
                parts.append(tail)
        return F.concat(*parts)

    def render_message(self, m: Column) -> Column:
        default = self._around(self.prefix, self.suffix, m)
        if not self.markers:
            return default
        out: Column | None = None
        for role, (prefix, suffix) in self.markers.items():
            text = self._around(prefix, suffix, m)
            out = F.when(m["role"] == role, text) if out is None else out.when(m["role"] == role, text)
        return out.otherwise(default)

    def render(self, messages: Column, add_generation_prompt: bool = False) -> Column:
        text = F.array_join(F.transform(messages, self.render_message), "")
        return F.concat(text, F.lit(self.generation)) if add_generation_prompt else text

    def render_prompt(self, messages: Column, last_assistant: Column) -> Column:
        """Everything before the last assistant message, then the start marker."""
        before = F.slice(messages, F.lit(1), F.greatest(last_assistant, F.lit(0)).cast("int"))
        return self.render(before, add_generation_prompt=True)

    def render_upto(self, messages: Column, last_assistant: Column) -> Column:
        """Everything up to and including the last assistant message."""
        through = F.slice(messages, F.lit(1), (F.greatest(last_assistant, F.lit(0)) + 1).cast("int"))
        return self.render(through)

    def _markers(self) -> list[tuple[str, str]]:
        return [(self.prefix, self.suffix), *self.markers.values()]

    def parts_messages(self) -> bool:
        """Whether a blank stands at every border of messages, whatever they hold."""
        starts = [prefix for prefix, _ in self._markers()] + [self.generation]
        ends = [suffix for _, suffix in self._markers()]
        return all(e[-1:] in _BLANKS and e for e in ends) or all(s[:1] in _BLANKS and s for s in starts)

    def has_token(self) -> bool:
        """Whether every message has a token, even an empty one."""
        return all((prefix + suffix).replace("{role}", "").strip(_BLANKS) for prefix, suffix in self._markers())

    def rejects(self, facts: Column) -> Column:
        bad = facts["malformed"]
        return bad | ~facts["alternates"] if self.strict_alternation else bad


def render_plain(messages: Column) -> Column:
    """``role: content`` lines, for tokenizers without a chat template."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"
    )


def plain_answer(messages: Column, last_assistant: Column) -> Column:
    """The last assistant message in the form ``render_plain`` gives it."""
    return F.concat(F.lit("assistant: "), F.get(messages, last_assistant.cast("int"))["content"])
