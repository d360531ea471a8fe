"""Operators on texts sized in tokens: encoding, packing, splitting. Nothing outside this package imports it."""
