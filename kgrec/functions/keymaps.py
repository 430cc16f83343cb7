"""Feature-name maps for completion normalisation.

Fixed values: these four maps must equal the ones the original pipeline ships, key for key, so that
parsed completions normalise to the same relation names.  They are passed to
``operators.triples.normalize_features`` as a parameter; any other map works the same way.
"""

# --- fixed values (book catalogue, item side) ---
BOOK_ITEM_KEYS = {
    "genre": "genre",
    "plot": "plot",
    "subject": "subject",
    "writing style": "writing_style",
    "genres": "genre",
    "author": "author",
    "mood": "mood",
    "topic": "topic",
    "country": "country",
    "kind": "kind_book",
    "kind of book": "kind_book",
    "kind of plot": "kind_plot",
    "country in which the book has been written": "country",
}

# --- fixed values (book catalogue, user side) ---
BOOK_USER_KEYS = {
    "genre": "fav_genre",
    "topics": "fav_topic",
    "subjects": "fav_subject",
    "kind of plot": "fav_kind_plot",
    "writing style": "fav_writing_style",
    "kind of books": "fav_kind_book",
}

# --- fixed values (movie catalogue, item and user side share one map) ---
MOVIE_KEYS = {
    "genre": "genre",
    "genres": "genre",
    "kind_of_plot": "kind_of_plot",
    "kind_of_musical_score": "kind_of_musical_score",
    "kind mood_for_the_musical_score plot": "mood_for_the_musical_score",
    "visual_style": "visual_style",
    "writing_style": "writing_style",
    "runtime": "runtime",
    "theme": "themes",
    "themes": "themes",
}
MOVIE_ITEM_KEYS = MOVIE_KEYS
MOVIE_USER_KEYS = MOVIE_KEYS

# --- fixed values (prompt wording) ---
ITEM_PROMPT_PREFIX = {"book": "The book you have to infer information is: ",
                      "movie": "The movie you have to infer information is: "}
USER_PROMPT_PREFIX = {"book": "My favourite books are: ",
                      "movie": "My favourite movies are: "}
GENERATED_PREFIX = "llama_generated/"
FAVOURITE_PREFIX = "Favourite "
