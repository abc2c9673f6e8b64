"""Reading and writing: tables, captured documents, archives."""
