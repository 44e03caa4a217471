"""Operators for preparing training data at corpus scale.

Each module holds one operator; ``queries`` applies them to whole tables with production parameters.
Nothing outside this subpackage imports it.
"""
