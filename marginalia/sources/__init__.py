"""Tables of the transcription corpus, and readers that turn raw input into rows."""
