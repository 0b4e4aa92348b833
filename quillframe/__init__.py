"""quillframe: document-record analytics as Spark plans."""
