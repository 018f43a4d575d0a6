"""Options in which query dialects differ, and the two presets."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Dialect:
    #: Folds the case of =, != and IN on text.
    case_insensitive: bool = True
    #: Folds the case of <, <=, > and >= on text too, if case_insensitive.
    fold_order: bool = True
    #: Contains, StartsWith and EndsWith fold case; None: as case_insensitive says.
    fold_methods: bool | None = True
    like_fold: bool = True
    #: LIKE reads numbers and booleans as text; else they don't match.
    like_stringify: bool = False
    #: Numbers compare with text that holds a number.
    coerce_text_numbers: bool = False
    #: NULL != 'x' holds.
    null_ne_is_true: bool = False
    #: Length() of a number is that of its digits; else the predicate is false.
    length_of_numbers: bool = True
    #: AND and OR from left to right, without precedence.
    flat_logic: bool = False

    @property
    def methods_fold(self) -> bool:
        return self.case_insensitive if self.fold_methods is None else self.fold_methods

    def but(self, **changes) -> Dialect:
        return replace(self, **changes)


VIEW = Dialect()
DOCUMENT = Dialect(
    case_insensitive=False, fold_order=False, fold_methods=None, like_fold=False, like_stringify=True,
    coerce_text_numbers=True, null_ne_is_true=True, length_of_numbers=False,
)
