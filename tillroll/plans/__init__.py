"""One function per business question: f(tables, scope, ...) -> DataFrame."""
