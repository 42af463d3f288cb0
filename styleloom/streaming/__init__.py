"""Nothing streams here: the analyses run once over a set of files."""
