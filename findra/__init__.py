"""findra: files and texts as tables, checks as queries, findings as rows."""
