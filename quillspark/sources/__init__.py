"""Sources: Word documents, seed questions, model responses."""
