"""Tokens know their ticker and time: token lists are not joined, and so not sorted, to learn them."""

from bellwether.plans import models
from bellwether.plans.catalogue import CATALOGUE


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_pooled_vectors_join_words_only(views):
    assert joins(CATALOGUE["token_pooled_vector_mean"].build(views)) == joins(views.words) + 1


def test_texts_of_sessions_join_the_day_map_only(views):
    assert joins(models.session_texts(views)) == joins(models.assign_session(views.news, views.calendar))


def test_training_texts_are_not_joined(views):
    assert joins(models.training_texts(views)) == 0
