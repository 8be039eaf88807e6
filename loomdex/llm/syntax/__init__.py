"""Syntax checks: recursive descent for statements, precedence climbing for expressions, panic-mode recovery."""

from __future__ import annotations

from loomdex.llm.syntax.base import Fault
from loomdex.llm.syntax.ecma import check_ecma
from loomdex.llm.syntax.php import check_php
from loomdex.llm.syntax.vue import check_vue

LANGUAGES = {"php": "php", "js": "javascript", "ts": "typescript", "vue": "vue"}


def check(language: str, text: str) -> list[Fault]:
    """All faults of a text in php, javascript, typescript or vue, in order."""
    if language == "php":
        return check_php(text)
    if language == "vue":
        return check_vue(text)
    return check_ecma(text, typed=language == "typescript")
