"""Writers: relations to one output a document."""
