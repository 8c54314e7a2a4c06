"""Sources and sinks: note files, gold corpora, a generated corpus, reports."""
