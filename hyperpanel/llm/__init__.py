"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it; the registry adds its queries only
when it is present.
"""
