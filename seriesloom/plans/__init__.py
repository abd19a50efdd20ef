"""Plans beyond one expression: blocked series, the flagship pipeline, the s-expression front end."""
