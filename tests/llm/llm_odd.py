"""Rows that every operator must stand."""

ODD = [(None, "no id here"), (None, None), (90, None), (91, ""), (92, " "), (93, "x"), (94, "é ß \U0001f600 ne\u0301"), (95, "same text twice in a row"), (95, "same text twice in a row"), (96, "same text twice in a row"), (95, "another text of the same id")]
