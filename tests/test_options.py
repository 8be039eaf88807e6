import pytest

from loomdex.functions import options as O


def test_values_of_options():
    assert O.texts_of(" a ") == ["a"] and O.texts_of(["a", "", None, " b"]) == ["a", "b"] and O.texts_of([]) is None and O.texts_of(None) is None
    assert O.ints_of("0, 1") == [0, 1] and O.ints_of([2, "3"]) == [2, 3] and O.ints_of(4) == [4] and O.ints_of("") is None
    assert O.int_of(" 5 ") == 5 and O.int_of("") is None and O.flag_of("Yes") is True and O.flag_of("off") is False and O.flag_of(None) is None and O.flag_of("") is None
    assert O.path_of("~") != "~" and O.path_of("") is None
    with pytest.raises(ValueError):
        O.flag_of("perhaps")
