"""Column functions: text, prompts, response parsing."""
